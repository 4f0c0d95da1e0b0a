"""Streams, each run to the end of its input; results are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import running, stateful
from . import micros, query, rounded, table

DAY = 86_400_000_000


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "event_id", "event_type", F.timestamp_micros(micros("ts")).alias("time"), micros("ts").alias("k"), F.col("value").alias("v"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return _named(running.source(spark, f"{d}/events.parquet"))


def _steps(spark: SparkSession, d: str, n: int = 3) -> list[DataFrame]:
    """All events in order of time, dealt into steps of about the same size; state from one is needed in the next."""
    rows = table(spark, d, "events")
    ends = rows.agg(F.percentile_approx(micros("ts"), [i / n for i in range(1, n)])).head()[0]
    place = sum((F.when(micros("ts") > x, 1).otherwise(0) for x in ends), F.lit(0))
    return [rows.where(place == i) for i in range(n)]


def _halves(spark: SparkSession, d: str) -> list[DataFrame]:
    """The later half of the time first."""
    rows = table(spark, d, "events")
    m = rows.select(micros("ts").alias("k")).agg(F.expr("(min(k) + max(k)) div 2")).head()[0]
    return [rows.where(micros("ts") >= m), rows.where(micros("ts") < m)]


_M = "(SELECT (min(k) + max(k)) // 2 FROM e)"


@query("src8_live_rate", "SELECT i AS k, i * 0.5 AS v FROM range(100) t(i)")
def src8(spark: SparkSession, d: str) -> DataFrame:
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 100).option("numPartitions", 2).load()
    return running.drained(rate.select(F.col("value").alias("k"), (F.col("value") * 0.5).alias("v")), "rate")


@query("str1_stream_map_filter", "SELECT user_id, k, round(v * 2, 4) AS v FROM e WHERE v > 50")
def str1(spark: SparkSession, d: str) -> DataFrame:
    return running.drained(_live(spark, d).where("v > 50").select("user_id", "k", F.round(F.col("v") * 2, 4).alias("v")), "map")


@query("str3_stream_zip", "SELECT a.user_id, a.k, round(a.v + b.v, 4) AS v FROM (SELECT * FROM e WHERE v > 20) a JOIN (SELECT * FROM e WHERE v < 80) b ON a.user_id = b.user_id AND a.k = b.k")
def str3(spark: SparkSession, d: str) -> DataFrame:
    a = _live(spark, d).where("v > 20").withWatermark("time", "1 hour").select("user_id", "k", "time", F.col("v").alias("l"))
    b = _live(spark, d).where("v < 80").withWatermark("time", "1 hour").select(F.col("user_id").alias("u"), F.col("k").alias("q"), F.col("time").alias("t"), F.col("v").alias("r"))
    both = a.join(b, (F.col("user_id") == F.col("u")) & (F.col("k") == F.col("q")) & (F.col("time") == F.col("t")))
    return running.drained(both.select("user_id", "k", F.round(F.col("l") + F.col("r"), 4).alias("v")), "zip")


@query("str4_stream_repeat_zip", "SELECT l.user_id, l.k, l.v AS l, r.v AS r FROM (SELECT * FROM e WHERE event_type = 'purchase') l ASOF JOIN (SELECT * FROM e WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.k >= r.k")
def str4(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("event_type") == "click", "r").otherwise("l").alias("side")
    rows = lambda live: _named(live).where("event_type IN ('purchase', 'click')").select("user_id", "k", "v", side)
    return running.stepped(spark, _steps(spark, d), lambda live: stateful.carried(rows(live), "user_id"), "carried")


@query("str5_stream_bars", f"SELECT user_id, k // {DAY} * {DAY} AS slice, arg_min(v, k) AS open, max(v) AS high, min(v) AS low, arg_max(v, k) AS close, count(*) AS volume FROM e GROUP BY 1, 2")
def str5(spark: SparkSession, d: str) -> DataFrame:
    """Complete mode keeps the last windows too, which append mode holds back for rows that may still come."""
    bars = stateful.tumbling_bars(_live(spark, d).withColumnRenamed("v", "price"), "user_id", "time", "price", "1 day", "1 hour")
    return running.drained(bars, "bars", "complete")


@query("str6_stream_sma", "SELECT user_id, k, round(avg(v) OVER (PARTITION BY user_id ORDER BY k ROWS 4 PRECEDING), 4) AS v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) >= 5")
def str6(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda live: stateful.moving_mean(_named(live).select("user_id", "k", "v"), "user_id", 5)
    return running.stepped(spark, _steps(spark, d), mean, "mean").withColumn("v", rounded("v"))


@query("str6_stream_lag", "SELECT user_id, k, v, lag(k) OVER w AS lag_k, lag(v) OVER w AS lag_v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k) QUALIFY row_number() OVER w > 1")
def str6_lag(spark: SparkSession, d: str) -> DataFrame:
    return running.stepped(spark, _steps(spark, d), lambda live: stateful.lagged(_named(live).select("user_id", "k", "v"), "user_id"), "lag")


@query("str2_notified", "SELECT 2::BIGINT AS step, count(*) AS n, max(k) AS last_key FROM e")
def str2(spark: SparkSession, d: str) -> DataFrame:
    """What a subscriber was told last: each step that arrives starts a trigger, which updates the count and the last key."""
    first, second = _halves(spark, d)
    told = lambda live: _named(live).groupBy().agg(F.count("*").alias("n"), F.max("k").alias("last_key"))
    return running.stepped(spark, [second, first], told, "told", "complete").select(F.lit(2).cast("long").alias("step"), "n", "last_key")


@query("str4_same_code_on_batches", "SELECT user_id, k, round(v * 2, 4) AS v, true AS same FROM e WHERE v > 50")
def str4_batch(spark: SparkSession, d: str) -> DataFrame:
    """One definition, run over the table as one batch and over the same rows as a stream of blocks."""
    both = lambda rows: _named(rows).where("v > 50").select("user_id", "k", F.round(F.col("v") * 2, 4).alias("v"))
    batch, stream = both(table(spark, d, "events")), running.stepped(spark, _steps(spark, d, 2), both, "blocks")
    on = ["user_id", "k"]
    return batch.join(stream.withColumnRenamed("v", "w"), on, "full").select(*on, "v", F.col("v").eqNullSafe(F.col("w")).alias("same"))


@query("str6_stream_width_sum", f"SELECT user_id, k, round(sum(v) OVER (PARTITION BY user_id ORDER BY k RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), 4) AS v FROM e")
def str6_width(spark: SparkSession, d: str) -> DataFrame:
    """Retention: a user's state holds a day of rows and is given up when the watermark has passed it."""
    total = lambda live: stateful.retained_sum(_named(live).select("user_id", "time", "k", "v"), "user_id", "time", DAY, "1 hour")
    return running.stepped(spark, _steps(spark, d), total, "width").withColumn("v", rounded("v"))


@query("str7_completed", "SELECT true AS completed, count(*) AS n FROM e")
def str7(spark: SparkSession, d: str) -> DataFrame:
    """The stream ends by itself when its input is used up, and all of it has been seen."""
    out = running.drained(_live(spark, d).select("user_id", "k"), "completed")
    return out.agg(F.lit(not spark.streams.active).alias("completed"), F.count("*").alias("n"))


@query("str8_late_rows", f"SELECT user_id, k, v, (SELECT max(k) FROM e f WHERE f.user_id = e.user_id) AS last FROM e WHERE k < {_M} AND user_id IN (SELECT user_id FROM e WHERE k >= {_M})")
def str8(spark: SparkSession, d: str) -> DataFrame:
    """The earlier half comes last: every row of it is reported whose user has later ones."""
    rows = lambda live: stateful.late_rows(_named(live).select("user_id", "k", "v"), "user_id")
    out = running.stepped(spark, _halves(spark, d), rows, "late")
    last = _named(table(spark, d, "events")).groupBy("user_id").agg(F.max("k").alias("most"))
    middle = table(spark, d, "events").select(micros("ts").alias("k")).agg(F.expr("(min(k) + max(k)) div 2")).scalar()
    return out.join(last.where(F.col("most") >= middle), "user_id").select("user_id", "k", "v", "last")


@query("str9_versioned_append", "SELECT user_id, n AS version, v, n < 5 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n FROM e) WHERE n <> 5")
def str9_versions(spark: SparkSession, d: str) -> DataFrame:
    """The fifth append of each user is missing: those before are accepted over several triggers, those behind the gap are refused."""
    rows = _named(table(spark, d, "events")).select("user_id", "v", F.row_number().over(Window.partitionBy("user_id").orderBy("k")).cast("long").alias("version")).where("version <> 5")
    steps = [rows.where("version <= 3"), rows.where("version IN (4, 6)"), rows.where("version > 6")]
    return running.stepped(spark, steps, lambda live: stateful.versioned(live, "user_id"), "versions")


@query("str11_state_is_given_up", "SELECT count(DISTINCT user_id) AS users, true AS fewer FROM e")
def str11(spark: SparkSession, d: str) -> DataFrame:
    """A month after the last event, the state of all users but the one who then comes is gone."""
    rows = table(spark, d, "events")
    month = lambda n: rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(30 * n)))
    total = lambda live: stateful.retained_sum(_named(live).select("user_id", "time", "k", "v"), "user_id", "time", DAY, "1 hour")
    out = running.stepped(spark, [rows, month(1), month(2)], total, "given_up")
    left = running.kept_states(spark, out)
    return rows.agg(F.count_distinct("user_id").alias("users"), F.lit(left <= 1).alias("fewer"))


@query("str9_stream_dedup_versions", "SELECT event_id AS version, v FROM e")
def str9(spark: SparkSession, d: str) -> DataFrame:
    rows = _live(spark, d).withWatermark("time", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return running.drained(rows.select(F.col("event_id").alias("version"), "v"), "versions")
