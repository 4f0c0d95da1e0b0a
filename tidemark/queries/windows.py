"""Lags, windows by count and width, and moving statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moving
from ..plans.frames import Frame, Lookup
from . import daily_orders, query, rounded, shipments, user_series

HOUR = 3_600_000_000
#: Width of the windows over users' events, in microseconds.
W = 48 * HOUR

_BY = "PARTITION BY user_id ORDER BY k"


def _left(sign: str) -> str:
    """Rows of an event's GE or GT window: from the last key at or before k - w."""
    return f"""x AS (SELECT a.user_id, a.k, a.v, (SELECT max(b.k) FROM e b WHERE b.user_id = a.user_id AND b.k {sign} a.k - {W}) AS lo FROM e a),
    g AS (SELECT x.user_id, x.k, x.v AS last_v, e.k AS kk, e.v AS vv FROM x JOIN e ON e.user_id = x.user_id AND e.k BETWEEN x.lo AND x.k WHERE x.lo IS NOT NULL)"""


def _flat(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "v"), *(F.col(f"v.{n}").alias(n) for n in names))


def _lag(name: str, block: int | None = None) -> None:
    @query(name, f"SELECT user_id, k, v, lag(k, 2) OVER w AS lag_k, lag(v, 2) OVER w AS lag_v FROM e WINDOW w AS ({_BY}) QUALIFY row_number() OVER w > 2 AND (row_number() OVER w - 3) % 3 = 0")
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = user_series(spark, d).lag(2, step=3, block=block).to_df()
        return out.select("user_id", "k", F.col("v.value").alias("v"), F.col("v.lagged.key").alias("lag_k"), F.col("v.lagged.value").alias("lag_v"))


_lag("lag1_lag")
_lag("lag1_lag_blocks", 1000)


@query("lag2_zip_lag", f"SELECT user_id, k, round(v - lag(v) OVER w, 4) AS v FROM e WINDOW w AS ({_BY}) QUALIFY row_number() OVER w > 1")
def lag2(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).zip_lag(lambda v, p: F.round(v - p, 4)).to_df()


@query("lag3_zip_lag_keys", f"SELECT user_id, k, round((v - lag(v) OVER w) / ((k - lag(k) OVER w) / 1000000.0), 6) + 0.0 AS v FROM e WINDOW w AS ({_BY}) QUALIFY row_number() OVER w > 1")
def lag3(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).zip_lag(lambda k, v, pk, pv: F.round((v - pv) / ((k - pk) / 1e6), 6) + 0.0).to_df()


def _count(name: str, n: int, incomplete: bool, block: int | None = None) -> None:
    keep = "" if incomplete else f"QUALIFY row_number() OVER ({_BY}) >= {n}"

    @query(name, f"SELECT user_id, k, count(*) OVER f AS n, round(sum(v) OVER f, 4) AS total FROM e WINDOW f AS ({_BY} ROWS {n - 1} PRECEDING) {keep}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = user_series(spark, d).windowed(Frame(count=n, incomplete=incomplete, block=block), n="count", total="sum").to_df()
        return _flat(out, "n", "total").withColumn("total", rounded("total"))


_count("win1_count_complete", 10, False)
_count("win1_count_complete_blocks", 10, False, 1000)
_count("win2_count_incomplete", 10, True)
_count("win2_count_incomplete_blocks", 10, True, 1000)


def _width(name: str, lookup: Lookup, sql: str, block: int | None = None) -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = user_series(spark, d).windowed(Frame(width=W, lookup=lookup, block=block), n="count", total="sum", least="min", most="max", dev="std").to_df()
        out = _flat(out, "n", "total", "least", "most", "dev")
        return out.withColumn("total", rounded("total")).withColumn("dev", rounded("dev"))


_NATIVE = "SELECT user_id, k, count(*) OVER f AS n, round(sum(v) OVER f, 4) AS total, min(v) OVER f AS least, max(v) OVER f AS most, round(stddev_samp(v) OVER f, 4) AS dev FROM e WINDOW f AS ({} RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
_GROUPED = "WITH {} SELECT user_id, k, count(*) AS n, round(sum(vv), 4) AS total, min(vv) AS least, max(vv) AS most, round(stddev_samp(vv), 4) AS dev FROM g GROUP BY user_id, k"
_width("win3_width_le", Lookup.LE, _NATIVE.format(_BY, W))
_width("win3_width_le_blocks", Lookup.LE, _NATIVE.format(_BY, W), 4 * W)
_width("win4_width_lt", Lookup.LT, _NATIVE.format(_BY, W - 1))
_width("win5_width_ge", Lookup.GE, _GROUPED.format(_left("<=")))
_width("win5_width_ge_blocks", Lookup.GE, _GROUPED.format(_left("<=")), 4 * W)
_width("win6_width_gt", Lookup.GT, _GROUPED.format(_left("<")))
_width("win6_width_gt_blocks", Lookup.GT, _GROUPED.format(_left("<")), 4 * W)


@query("win7_width_eq_refused", "SELECT 'EQ has no meaning for a window''s left edge' AS message")
def win7(spark: SparkSession, d: str) -> DataFrame:
    try:
        user_series(spark, d).sma(width=W, lookup=Lookup.EQ)
        message = ""
    except ValueError as e:
        message = str(e)
    return spark.range(1).select(F.lit(message).alias("message"))


@query("win8_while_predicate", f"SELECT user_id, k, max(v) OVER (PARTITION BY user_id, r ORDER BY k) AS run_max FROM (SELECT *, sum((v > 90)::INT) OVER ({_BY}) AS r FROM e)")
def win8(spark: SparkSession, d: str) -> DataFrame:
    return moving.runs(user_series(spark, d), lambda v: v > 90)


@query("wf1_window_rows", f"SELECT user_id, k, len(list(v) OVER f) AS n, round(list_sum(list(v) OVER f), 4) AS total, min(k) OVER f AS first_k FROM e WINDOW f AS ({_BY} ROWS 4 PRECEDING) QUALIFY row_number() OVER ({_BY}) >= 5")
def wf1(spark: SparkSession, d: str) -> DataFrame:
    out = user_series(spark, d).window(count=5).to_df()
    total = F.aggregate("v", F.lit(0.0), lambda a, r: a + r["v"])
    return out.select("user_id", "k", F.size("v").cast("long").alias("n"), rounded(total).alias("total"), F.col("v")[0]["k"].alias("first_k"))


@query("wf2_window_map", f"SELECT user_id, k, round(max(v) OVER f - min(v) OVER f, 4) AS v FROM e WINDOW f AS ({_BY} ROWS 9 PRECEDING) QUALIFY row_number() OVER ({_BY}) >= 10")
def wf2(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).windowed(Frame(count=10), hi="max", lo="min").map(lambda v: F.round(v["hi"] - v["lo"], 4)).to_df()


@query("wf3_sma_count", f"SELECT user_id, k, round(avg(v) OVER ({_BY} ROWS 4 PRECEDING), 4) AS v FROM e QUALIFY row_number() OVER ({_BY}) >= 5")
def wf3(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).sma(count=5).map(rounded).to_df()


@query("wf3_sma_width", f"WITH {_left('<=')} SELECT user_id, k, round(avg(vv), 8) AS v FROM g GROUP BY user_id, k")
def wf3_width(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).sma(width=W).map(lambda v: rounded(v, 8)).to_df()


@query("wf4_moving_sum", "SELECT l_partkey, k, sum(v) OVER (PARTITION BY l_partkey ORDER BY k ROWS 6 PRECEDING) AS v FROM s")
def wf4(spark: SparkSession, d: str) -> DataFrame:
    return shipments(spark, d).windowed(Frame(count=7, incomplete=True), total="sum").to_df()


_STATS = """SELECT user_id, min(k) OVER f AS start, k, v AS end_value, count(*) OVER f AS n, round(sum(v) OVER f, 4) AS total, round(avg(v) OVER f, 8) AS mean,
    round(sqrt(var_samp(v) OVER f * (count(*) OVER f - 1)), 5) AS root_sum2, round(ln(1 + var_samp(v) OVER f), 6) AS log_variance, round(stddev_samp(v) OVER f, 4) AS stdev,
    round(CASE WHEN stddev_samp(v) OVER f > 0 THEN (v - avg(v) OVER f) / stddev_samp(v) OVER f END, 4) AS zscore FROM e WINDOW f AS ({} {})"""


def _stats(df: DataFrame) -> DataFrame:
    """Roots and logarithms in place of sums of squares, which end in ties that engines round apart."""
    return df.select("user_id", F.col("v.start").alias("start"), "k", F.col("v.end_value").alias("end_value"), F.col("v.count").alias("n"), rounded("v.sum").alias("total"), rounded("v.mean", 8).alias("mean"), rounded(F.sqrt("v.sum2"), 5).alias("root_sum2"), rounded(F.log1p("v.variance"), 6).alias("log_variance"), rounded("v.stdev").alias("stdev"), rounded("v.zscore").alias("zscore"))


@query("wf5_stat2_count", _STATS.format(_BY, "ROWS 19 PRECEDING") + f" QUALIFY row_number() OVER ({_BY}) >= 20")
def wf5(spark: SparkSession, d: str) -> DataFrame:
    return _stats(user_series(spark, d).stat2(count=20).to_df())


@query("wf5_stat2_width", _STATS.format(_BY, f"RANGE BETWEEN {W} PRECEDING AND CURRENT ROW"))
def wf5_width(spark: SparkSession, d: str) -> DataFrame:
    return _stats(user_series(spark, d).stat2(width=W, lookup=Lookup.LE).to_df())


@query("wf6_moving_average_width", f"SELECT user_id, k, round(avg(v) OVER ({_BY} RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW), 8) AS v FROM e")
def wf6(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).sma(width=W, lookup=Lookup.LT).map(lambda v: rounded(v, 8)).to_df()


@query("wf7_moving_median", f"SELECT user_id, k, round(median(v) OVER ({_BY} ROWS 9 PRECEDING), 4) AS v FROM e QUALIFY row_number() OVER ({_BY}) >= 10")
def wf7(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).moving_median(10).map(rounded).to_df()


@query("wf8_moving_stdev", f"SELECT user_id, k, round(stddev_samp(v) OVER ({_BY} ROWS 19 PRECEDING), 4) AS v FROM e QUALIFY row_number() OVER ({_BY}) >= 2")
def wf8(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).windowed(Frame(count=20, incomplete=True), n="count", dev="std").filter(lambda v: v["n"] > 1).map(lambda v: rounded(v["dev"])).to_df()


@query("wf9_moving_regression", "SELECT k, round(regr_slope(v, p) OVER f, 4) AS slope, round(regr_intercept(v, p) OVER f, 2) AS intercept FROM (SELECT k, v, (k - 8000)::DOUBLE AS p FROM o) WINDOW f AS (ORDER BY k ROWS 29 PRECEDING) QUALIFY row_number() OVER (ORDER BY k) >= 30")
def wf9(spark: SparkSession, d: str) -> DataFrame:
    out = moving.regression(daily_orders(spark, d).map_pairs(lambda k, v: F.struct(v.alias("y"), (k - 8000).cast("double").alias("x"))), 30)
    return out.select("k", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("wf9_moving_regression_many")
def wf9_many(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d).map_pairs(lambda k, v: F.struct((v * 0.25 + 1.5 * (k % 97) + 0.33).alias("y"), F.array(F.lit(1.0), v, (k % 97).cast("double")).alias("x")))
    out = moving.regression_many(s, 3, 20, 5)
    return out.select("user_id", "k", F.transform("beta", lambda b: F.round(b, 4)).alias("beta"))


@query("wf10_sort_rank", f"SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY v, k) - 1 AS rank FROM e")
def wf10(spark: SparkSession, d: str) -> DataFrame:
    return moving.sort_rank(user_series(spark, d))


@query("wf11_top_n", "SELECT user_id, k, v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, k) <= 3")
def wf11(spark: SparkSession, d: str) -> DataFrame:
    return moving.top_n(user_series(spark, d), 3)
