"""Changes to series, sinks, encodings, panels and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel
from ..plans.frames import Lookup
from ..plans.staging import fresh
from ..sources import encodings, sinks
from . import daily_orders, events, query, rounded, shipments, table, user_series

DAY = 86_400_000_000


@query("src9_append", "SELECT k, v FROM o WHERE k <= 9200 UNION ALL SELECT k, round(v + 1, 2) FROM o WHERE k > 9200")
def src9_append(spark: SparkSession, d: str) -> DataFrame:
    s = daily_orders(spark, d)
    more = s.after(9000).map(lambda v: F.round(v + 1, 2)).to_df()
    return s.before(9200).append(more, on_conflict="skip").to_df()


@query("src9_upsert", "SELECT k, CASE WHEN k % 3 = 0 THEN round(v * 2, 2) ELSE v END AS v FROM o")
def src9_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = daily_orders(spark, d)
    return s.upsert(s.filter_keys(lambda k: k % 3 == 0).map(lambda v: F.round(v * 2, 2)).to_df()).to_df()


@query("src9_prepend", "SELECT k, v FROM o")
def src9_prepend(spark: SparkSession, d: str) -> DataFrame:
    s = daily_orders(spark, d)
    return s.after(9200).prepend(s.before(9200, incl=False).to_df()).to_df()


@query("src9_remove", "SELECT k, v FROM o WHERE k % 5 <> 0")
def src9_remove(spark: SparkSession, d: str) -> DataFrame:
    s = daily_orders(spark, d)
    return s.remove(s.filter_keys(lambda k: k % 5 == 0).to_df().select("k")).to_df()


@query("src9_remove_many", "SELECT k, v FROM o WHERE k > 9000 AND k < (SELECT max(k) FROM o)")
def src9_remove_many(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).remove_many(9000, Lookup.LE).remove_last().to_df()


@query("src9_remove_first", "SELECT user_id, k, v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) > 1")
def src9_remove_first(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).remove_first().to_df()


@query("src11_retain_span", f"SELECT user_id, k, v FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS last FROM e) WHERE last - k < {DAY * 3}")
def src11_span(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).retain(span=3 * DAY).to_df()


@query("src11_retain_count", "SELECT user_id, k, v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) <= 10")
def src11_count(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).retain(count=10).to_df()


@query("sink1_binary_round_trip", "SELECT user_id, k, v FROM e")
def sink1(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "series")
    sinks.write(user_series(spark, d), path, "binary", "zstd")
    return sinks.read(spark, path, ("user_id",)).to_df()


@query("sink2_json_round_trip", "SELECT k, v FROM o")
def sink2(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "series")
    sinks.write(daily_orders(spark, d), path, "json", "gzip")
    return sinks.read(spark, path, (), "json", "k long, v double").to_df()


@query("sink3_formats", "SELECT f AS format, c AS compression, (SELECT count(*) FROM o) AS n FROM (VALUES ('binary', 'none'), ('binary', 'gzip'), ('binary', 'lz4'), ('binary', 'zstd'), ('json', 'none'), ('json', 'gzip')) t(f, c)")
def sink3(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, codec in (("binary", "none"), ("binary", "gzip"), ("binary", "lz4"), ("binary", "zstd"), ("json", "none"), ("json", "gzip")):
        path = fresh(spark, "series")
        sinks.write(daily_orders(spark, d), path, kind, codec)
        n = sinks.read(spark, path, (), kind, "k long, v double").to_df().agg(F.count("*").alias("n"))
        row = n.select(F.lit(kind).alias("format"), F.lit(codec).alias("compression"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("sink4_byte_shuffle", "SELECT vec_id, true AS same FROM embeddings")
def sink4(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("vec_id", F.encode(F.array_join(F.col("embedding").cast("array<string>"), ","), "UTF-8").alias("raw"))
    return df.select("vec_id", (encodings.unshuffled(encodings.shuffled(F.col("raw"), F.lit(8)), F.lit(8)) == F.col("raw")).alias("same"))


_BYTES = "(props || event_id)"


@query(
    "sink4_byte_shuffle_bytes",
    f"""SELECT event_id, array_to_string(list_transform(range(n * 4), lambda j: substr(s, (j % n) * 4 + j // n + 1, 1)), '') || substr(s, n * 4 + 1) AS dealt
    FROM (SELECT event_id, {_BYTES} AS s, length({_BYTES}) // 4 AS n FROM events)""",
)
def sink4_bytes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode(F.concat("props", F.col("event_id").cast("string")), "UTF-8")
    return table(spark, d, "events").select("event_id", F.decode(encodings.shuffled(raw, F.lit(4)), "UTF-8").alias("dealt"))


@query("sink5_delta_encode", "SELECT k, round(v - coalesce(lag(v) OVER (ORDER BY k), 0), 2) AS delta FROM o")
def sink5_encode(spark: SparkSession, d: str) -> DataFrame:
    return encodings.delta_encoded(daily_orders(spark, d)).to_df(value="delta").withColumn("delta", F.round("delta", 2))


@query("sink5_delta_decode", "SELECT l_partkey, k, v FROM s")
def sink5_decode(spark: SparkSession, d: str) -> DataFrame:
    return encodings.delta_decoded(encodings.delta_encoded(shipments(spark, d))).to_df()


_OLD = "(SELECT k, k % 10 AS c, v FROM o WHERE k <= 9900)"
_NEW = "(SELECT k, k % 10 AS c, CASE WHEN k % 4 = 0 THEN round(v + 5, 2) ELSE v END AS v FROM o WHERE k >= 8100)"


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = daily_orders(spark, d).to_df()
    cells = o.select(F.col("k").alias("row"), (F.col("k") % 10).alias("col"), "v")
    return cells.where("row <= 9900"), cells.where("row >= 8100").withColumn("v", F.when(F.col("row") % 4 == 0, F.round(F.col("v") + 5, 2)).otherwise(F.col("v")))


@query("sink6_table_delta", f"SELECT coalesce(a.k, b.k) AS row, coalesce(a.c, b.c) AS col, CASE WHEN b.k IS NULL THEN 'removed' ELSE 'set' END AS change, b.v FROM {_OLD} a FULL JOIN {_NEW} b ON a.k = b.k AND a.c = b.c WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL")
def sink6(spark: SparkSession, d: str) -> DataFrame:
    return panel.cell_delta(*_cells(spark, d))


@query("sink6_table_apply", f"SELECT k AS row, c AS col, v FROM {_NEW}")
def sink6_apply(spark: SparkSession, d: str) -> DataFrame:
    old, new = _cells(spark, d)
    return panel.apply_delta(old, panel.cell_delta(old, new))


_KINDS = ("view", "signup", "error", "click", "purchase")


@query("m7_panel_wide", "SELECT user_id, " + ", ".join(f"round(sum(CASE WHEN event_type = '{x}' THEN v END), 4) AS {x}" for x in _KINDS) + " FROM e GROUP BY user_id")
def m7_wide(spark: SparkSession, d: str) -> DataFrame:
    long = events(spark, d, "event_type").groupBy("user_id", "event_type").agg(rounded(F.sum("v")).alias("v"))
    return panel.widened(long, "user_id", "event_type", "v", list(_KINDS))


@query("m7_panel_long", "SELECT user_id, event_type AS col, round(sum(v), 4) AS v FROM e GROUP BY 1, 2")
def m7_long(spark: SparkSession, d: str) -> DataFrame:
    return panel.lengthened(m7_wide(spark, d), ["user_id"], list(_KINDS))


@query("m8_matrix_product", "SELECT a.user_id AS row, b.c AS col, round(sum(a.v * b.w), 2) AS v FROM (SELECT user_id, event_type, sum(v) AS v FROM e GROUP BY 1, 2) a JOIN (SELECT DISTINCT event_type, c, length(event_type) * (c + 1) AS w FROM e, range(3) t(c)) b ON a.event_type = b.event_type GROUP BY 1, 2")
def m8(spark: SparkSession, d: str) -> DataFrame:
    long = events(spark, d, "event_type").groupBy("user_id", "event_type").agg(F.sum("v").alias("v"))
    other = events(spark, d, "event_type").select("event_type").distinct().withColumn("c", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    other = other.select("event_type", "c", (F.length("event_type") * (F.col("c") + 1)).alias("w"))
    return panel.product(long.toDF("row", "i", "v"), other.toDF("i", "col", "w")).withColumn("v", F.round("v", 2))


@query("m6_version_append", "SELECT event_id + 1 AS version, v FROM (SELECT event_id, v, min(event_id) OVER () AS f FROM e) WHERE event_id >= f")
def m6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_id") + 1).alias("version"), F.col("value").alias("v"))
    return panel.versioned(rows)
