"""Continuous series and zips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timekeys
from ..series import Series
from . import daily_orders, events, query, rounded, shipments, table, type_series

_T = "t AS (SELECT user_id, k, v, event_type AS x FROM e)"


def _asof(left: str, right: str) -> str:
    return f"SELECT l.user_id, l.k, l.v AS lv, r.v AS rv, r.k AS rk FROM (SELECT * FROM e WHERE event_type = '{left}') l ASOF JOIN (SELECT * FROM e WHERE event_type = '{right}') r ON l.user_id = r.user_id AND l.k >= r.k"


def _clicks_at_all(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "k")


@query("con1_fill", "SELECT user_id, k, CASE WHEN event_type = 'click' THEN v ELSE 42.0 END AS v FROM e")
def con1(spark: SparkSession, d: str) -> DataFrame:
    return type_series(spark, d, "click").fill(42.0).at(_clicks_at_all(spark, d))


@query("con2_repeat", "SELECT l.user_id, l.k, r.v FROM e l ASOF JOIN (SELECT * FROM e WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.k >= r.k")
def con2(spark: SparkSession, d: str) -> DataFrame:
    return type_series(spark, d, "click").repeat().at(_clicks_at_all(spark, d))


@query("con2_repeat_blocks", "SELECT l.user_id, l.k, r.v FROM e l ASOF JOIN (SELECT * FROM e WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.k >= r.k")
def con2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same, cut into blocks of four days, for partitions too large for a task."""
    return type_series(spark, d, "click").repeat(block=4 * 86_400_000_000).at(_clicks_at_all(spark, d))


@query("con3_repeat_with_key", "SELECT l.user_id, l.k, r.k AS origin, r.v FROM e l ASOF JOIN (SELECT * FROM e WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.k >= r.k")
def con3(spark: SparkSession, d: str) -> DataFrame:
    out = type_series(spark, d, "click").repeat_with_key().at(_clicks_at_all(spark, d))
    return out.select("user_id", "k", F.col("v.key").alias("origin"), F.col("v.value").alias("v"))


@query(
    "con4_interpolate",
    """WITH c AS (SELECT * FROM e WHERE event_type = 'click'),
    l AS (SELECT e.user_id, e.k, c.k AS lk, c.v AS lv FROM e ASOF JOIN c ON e.user_id = c.user_id AND e.k >= c.k),
    r AS (SELECT l.*, c.k AS rk, c.v AS rv FROM l ASOF JOIN c ON l.user_id = c.user_id AND l.k <= c.k)
    SELECT user_id, k, round(CASE WHEN lk = rk THEN lv ELSE lv + (rv - lv) * ((k - lk)::DOUBLE / (rk - lk)) END, 6) AS v FROM r""",
)
def con4(spark: SparkSession, d: str) -> DataFrame:
    return type_series(spark, d, "click").interpolate().at(_clicks_at_all(spark, d)).withColumn("v", rounded("v", 6))


@query("jon1_zip_discrete", "SELECT a.k, round(a.v, 2) AS l, b.n AS r FROM o a JOIN (SELECT epoch_us(l_shipdate) // 86400000000 AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def jon1(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(timekeys.to_micros("l_shipdate") / 86_400_000_000).cast("long")
    shipped = Series.of(table(spark, d, "lineitem").groupBy(day.alias("k")).agg(F.count("*").alias("n")), "k", "n")
    out = daily_orders(spark, d).zip(shipped).to_df()
    return out.select("k", F.round("v.l", 2).alias("l"), F.col("v.r").alias("r"))


@query("jon2_zip_right_repeat", f"SELECT user_id, k, round(lv + rv, 4) AS v FROM ({_asof('purchase', 'click')})")
def jon2(spark: SparkSession, d: str) -> DataFrame:
    return (type_series(spark, d, "purchase") + type_series(spark, d, "click").repeat()).map(rounded).to_df()


@query(
    "jon3_zip_left_fill",
    """SELECT s.l_partkey, s.k, round(coalesce(r.q, 10.0) - s.v, 2) AS v FROM s LEFT JOIN
    (SELECT l_partkey, epoch_us(l_shipdate) // 86400000000 AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) r ON s.l_partkey = r.l_partkey AND s.k = r.k""",
)
def jon3(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(timekeys.to_micros("l_shipdate") / 86_400_000_000).cast("long")
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", day.alias("k")).agg(F.sum("l_quantity").alias("v"))
    return (Series.of(returned, "k", "v", ("l_partkey",)).fill(10.0) - shipments(spark, d)).map(lambda v: rounded(v, 2)).to_df()


@query(
    "jon4_zip_both_continuous",
    """WITH q AS (SELECT * FROM e WHERE event_type IN ('click', 'view')),
    c AS (SELECT q.user_id, q.k, r.v AS rv, CASE WHEN q.event_type = 'view' THEN q.v ELSE 42.0 END AS fv FROM q ASOF JOIN (SELECT * FROM e WHERE event_type = 'click') r ON q.user_id = r.user_id AND q.k >= r.k)
    SELECT user_id, k, round(rv + fv, 4) AS v FROM c""",
)
def jon4(spark: SparkSession, d: str) -> DataFrame:
    return (type_series(spark, d, "click").repeat() + type_series(spark, d, "view").fill(42.0)).map(rounded).to_df()


@query("jon4_zip_both_at", "SELECT user_id, k, round((CASE WHEN event_type = 'click' THEN v ELSE 1.0 END) * (CASE WHEN event_type = 'view' THEN v ELSE 2.0 END), 4) AS v FROM e")
def jon4_at(spark: SparkSession, d: str) -> DataFrame:
    both = type_series(spark, d, "click").fill(1.0) * type_series(spark, d, "view").fill(2.0)
    return both.map(rounded).at(_clicks_at_all(spark, d))


@query("jon5_zip_selector", "SELECT k, round(v + k % 7 - n, 2) AS v FROM (SELECT a.k, a.v, b.n FROM o a JOIN (SELECT k, count(*) AS n FROM s GROUP BY 1) b ON a.k = b.k)")
def jon5(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(timekeys.to_micros("l_shipdate") / 86_400_000_000).cast("long")
    parts = Series.of(table(spark, d, "lineitem").groupBy(day.alias("k")).agg(F.countDistinct("l_partkey").alias("n")), "k", "n")
    return daily_orders(spark, d).zip(parts, lambda k, a, b: F.round(a + k % 7 - b, 2)).to_df()


@query("jon6_zip_n", "SELECT user_id, k, round(v + 2 * v + 3 * v, 4) AS v FROM e")
def jon6(spark: SparkSession, d: str) -> DataFrame:
    s = Series.of(events(spark, d), "k", "v", ("user_id",))
    return Series.zip_n([s, s * 2, s * 3], lambda k, a: F.round(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), 4)).to_df()


@query("jon6_zip_n_continuous", f"SELECT user_id, k, round((lv + rv + 5.0) / 3, 4) AS v FROM ({_asof('purchase', 'click')})")
def jon6_continuous(spark: SparkSession, d: str) -> DataFrame:
    a, b = type_series(spark, d, "purchase"), type_series(spark, d, "click").repeat()
    c = Series.constant(5.0, a)
    return Series.zip_n([a, b, c], lambda k, x: F.round(F.aggregate(x, F.lit(0.0), lambda p, q: p + q) / F.size(x), 4)).to_df()


@query("jon7_union_keys", "SELECT DISTINCT user_id, k FROM e WHERE event_type IN ('click', 'view', 'error')")
def jon7(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import sets

    return sets.union_keys(*(type_series(spark, d, x) for x in ("click", "view", "error")))


@query("jon9_asof", f"SELECT user_id, k, lv, rk, rv FROM ({_asof('error', 'view')})")
def jon9(spark: SparkSession, d: str) -> DataFrame:
    out = type_series(spark, d, "error").zip(type_series(spark, d, "view").repeat_with_key()).to_df()
    return out.select("user_id", "k", F.col("v.l").alias("lv"), F.col("v.r.key").alias("rk"), F.col("v.r.value").alias("rv"))


@query(
    "jon10_zone_offsets",
    """WITH z AS (SELECT * FROM (VALUES (0, -18000), (1712000000000000, -14400), (1730000000000000, -18000)) t(k, off))
    SELECT e.event_id, e.k + z.off::BIGINT * 1000000 AS local FROM e ASOF JOIN z ON e.k >= z.k""",
)
def jon10(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import zones

    offsets = Series.from_pairs(spark, [(0, -18000), (1712000000000000, -14400), (1730000000000000, -18000)], "k long, v long")
    return zones.shifted(events(spark, d, "event_id"), offsets)
