"""Whole-series statistics, time slices, grids, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, segments, timekeys
from ..operators import bars, grid, sets, summary
from ..series import Series
from . import daily_orders, events, query, rounded, shipments, table, type_series, user_series

HOUR, DAY = 3_600_000_000, 86_400_000_000


@query(
    "agg1_stat2",
    """SELECT user_id, count(*) AS n, round(sum(v), 4) AS total, round(avg(v), 4) AS mean, round(var_samp(v) * (count(*) - 1), 2) AS sum2, round(var_samp(v), 4) AS variance, round(stddev_samp(v), 4) AS stdev,
    min(k) AS start, max(k) AS "end", arg_max(v, k) AS end_value FROM e GROUP BY user_id""",
)
def agg1(spark: SparkSession, d: str) -> DataFrame:
    out = summary.stat2(user_series(spark, d))
    return out.select("user_id", F.col("count").alias("n"), rounded("sum").alias("total"), rounded("mean").alias("mean"), rounded("sum2", 2).alias("sum2"), rounded("variance").alias("variance"), rounded("stdev").alias("stdev"), "start", "end", "end_value")


@query("agg2_stat1", "SELECT user_id, count(*) AS n, round(sum(v), 4) AS total FROM e GROUP BY user_id")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    return summary.stat1(user_series(spark, d)).select("user_id", F.col("count").alias("n"), rounded("sum").alias("total"))


@query("agg3_group_by", "SELECT k % 7 AS g, count(*) AS n, round(sum(v), 2) AS total FROM o GROUP BY 1")
def agg3(spark: SparkSession, d: str) -> DataFrame:
    return summary.grouped(daily_orders(spark, d), lambda k: k % 7, n=lambda v: F.count("*"), total=lambda v: F.round(F.sum(v), 2))


@query("agg4_time_slice", f"SELECT user_id, k // {6 * HOUR} * {6 * HOUR} AS slice, count(*) AS n, round(sum(v), 4) AS total FROM e GROUP BY 1, 2")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    return bars.time_slice(user_series(spark, d), "hour", 6, n=lambda v: F.count("*"), total=lambda v: F.round(F.sum(v), 4))


@query("agg4_time_slice_fold", f"SELECT user_id, k // {DAY} * {DAY} AS slice, round(list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY k)), lambda a, x: a / 3 + x), 4) AS v FROM e GROUP BY 1, 2")
def agg4_fold(spark: SparkSession, d: str) -> DataFrame:
    return bars.fold(user_series(spark, d), "day", 1, F.lit(0.0), lambda a, r: a / 3 + r["v"]).withColumn("v", rounded("v"))


_FLOOR = f"(k - ((k + {719162 * DAY}) % {{}}))"


@query(
    "agg5_frame_start",
    f"SELECT event_id, {_FLOOR.format(7 * DAY)} AS week, {_FLOOR.format(5 * HOUR)} AS five_hours, k // {15 * 60_000_000} * {15 * 60_000_000} AS quarter, epoch_us(date_trunc('month', make_timestamp(k)))::BIGINT AS month, {-719162 * DAY}::BIGINT AS eternity FROM e",
)
def agg5(spark: SparkSession, d: str) -> DataFrame:
    at = timekeys.frame_start
    k = F.col("k")
    return events(spark, d, "event_id").select("event_id", at(k, "day", 7).alias("week"), at(k, "hour", 5).alias("five_hours"), at(k, "minute", 15).alias("quarter"), at(k, "month").alias("month"), at(k, "eternity").cast("long").alias("eternity"))


@query("agg6_cumulative", "SELECT user_id, k, count(*) OVER w AS n, round(sum(v) OVER w, 4) AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING)")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    return summary.cumulative(user_series(spark, d)).withColumn("total", rounded("total"))


@query("agg6_cumulative_blocks", "SELECT k, count(*) OVER w AS n, round(sum(v) OVER w, 2) AS total FROM o WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)")
def agg6_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One series without partitions, in blocks of ninety days."""
    return summary.cumulative(daily_orders(spark, d), block=90).withColumn("total", F.round("total", 2))


@query("agg7_ohlcv", f"SELECT user_id, k // {DAY} * {DAY} AS slice, arg_min(v, k) AS open, max(v) AS high, min(v) AS low, arg_max(v, k) AS close, count(*) AS volume FROM e GROUP BY 1, 2")
def agg7(spark: SparkSession, d: str) -> DataFrame:
    return bars.ohlcv(events(spark, d).withColumn("volume", F.lit(1).cast("long")), "k", "v", "volume", "day", 1, ("user_id",))


@query(
    "agg7_ohlcv_weak",
    """WITH x AS (SELECT k, (k + 719162 * 86400000000) // 604800000000 * 604800000000 - 719162 * 86400000000 AS slice, p, q FROM (SELECT epoch_us(l_shipdate) AS k, l_extendedprice AS p, l_quantity AS q FROM lineitem)),
    y AS (SELECT *, min(k) OVER (PARTITION BY slice) AS f, max(k) OVER (PARTITION BY slice) AS l FROM x)
    SELECT slice, min(p) FILTER (WHERE k = f) AS open, max(p) AS high, min(p) AS low, max(p) FILTER (WHERE k = l) AS close, sum(q) AS volume FROM y GROUP BY 1""",
)
def agg7_weak(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(timekeys.to_micros("l_shipdate").alias("k"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
    return bars.ohlcv(rows, "k", "p", "q", "day", 7)


@query("agg8_values", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, count(value) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return df.withColumn("total", rounded("total")).withColumn("mean", rounded("mean"))


_GRID = "SELECT a, b, c, -((200 - a) * (200 - a) + (10 - b) * (10 - b) + (70 - c) * (70 - c)) AS value FROM (SELECT unnest(range(0, 101, 4)) AS a), (SELECT unnest(range(0, 101, 5)) AS b), (SELECT unnest(range(0, 101, 10)) AS c)"


def _target(a, b, c):
    return -((200 - a) * (200 - a) + (10 - b) * (10 - b) + (70 - c) * (70 - c))


def _space() -> grid.Grid:
    return grid.Grid({"a": grid.Parameter(0, 100, 4), "b": grid.Parameter(0, 100, 5), "c": grid.Parameter(0, 100, 10)})


@query("agg9_fold_grid", f"SELECT count(*) AS n, sum(value)::BIGINT AS total, min(value) AS least, max(value) AS most FROM ({_GRID})")
def agg9(spark: SparkSession, d: str) -> DataFrame:
    return grid.evaluate(spark, _space(), _target).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("agg10_maximize", f"SELECT a, b, c, value FROM ({_GRID}) ORDER BY value DESC, a, b, c LIMIT 1")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    return grid.maximize(spark, _space(), _target)


@query("agg11_big_step", "SELECT 100::BIGINT AS a, 10::BIGINT AS b, 70::BIGINT AS c, -10000::BIGINT AS value")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    space = grid.Grid({x: grid.Parameter(0, 100, 1, 10) for x in "abc"})
    return grid.maximize_big_step(spark, space, _target)


@query("agg12_parameter_grid", "SELECT i AS position, least(i * 5, 19) AS value, i * 5 + 2 AS address FROM range(5) t(i)")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    space = grid.Grid({"x": grid.Parameter(0, 19, 5), "y": grid.Parameter(0, 4, 1)})
    points = space.points(spark).where("y = 2")
    return points.select((F.col("address") / 5).cast("long").alias("position"), F.col("x").alias("value"), "address")


@query("srt1_key_order", "SELECT user_id, k, row_number() OVER (ORDER BY user_id, k) AS place FROM e ORDER BY 1, 2 LIMIT 500")
def srt1(spark: SparkSession, d: str) -> DataFrame:
    return summary.ordered_head(user_series(spark, d), 500)


@query("srt2_reverse_order", "SELECT k, v FROM o ORDER BY k DESC LIMIT 100")
def srt2(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).to_df().orderBy(F.desc("k")).limit(100)


@query("srt1_key_order_whole", "SELECT user_id, k, v, row_number() OVER (ORDER BY user_id, k) AS place FROM e")
def srt1_whole(spark: SparkSession, d: str) -> DataFrame:
    return summary.ordered(user_series(spark, d))


@query("srt2_reverse_order_whole", "SELECT k, v, row_number() OVER (ORDER BY k DESC) AS place FROM o")
def srt2_whole(spark: SparkSession, d: str) -> DataFrame:
    return summary.ordered(daily_orders(spark, d), reverse=True)


@query("lim1_offset_take", "SELECT k, v FROM o ORDER BY k LIMIT 50 OFFSET 25")
def lim1(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).to_df().orderBy("k").offset(25).limit(50)


@query("set1_append_series", "SELECT k, v FROM o")
def set1(spark: SparkSession, d: str) -> DataFrame:
    s = daily_orders(spark, d)
    return s.before(9200).append(s.after(9200, incl=False).to_df()).to_df()


@query("set2_key_union", "SELECT DISTINCT user_id, k FROM e WHERE event_type IN ('click', 'purchase')")
def set2(spark: SparkSession, d: str) -> DataFrame:
    return sets.union_keys(type_series(spark, d, "click"), type_series(spark, d, "purchase"))


@query("set3_key_intersection", "SELECT DISTINCT k FROM o WHERE k IN (SELECT k FROM s)")
def set3(spark: SparkSession, d: str) -> DataFrame:
    parts = shipments(spark, d).to_df().groupBy("k").agg(F.sum("v").alias("v"))
    return sets.common_keys(daily_orders(spark, d), Series.of(parts, "k", "v"))


@query("set4_key_difference", "SELECT DISTINCT k FROM s WHERE k NOT IN (SELECT k FROM o)")
def set4(spark: SparkSession, d: str) -> DataFrame:
    parts = shipments(spark, d).to_df().groupBy("k").agg(F.sum("v").alias("v"))
    return sets.missing_keys(Series.of(parts, "k", "v"), daily_orders(spark, d))


@query("fn1_segments", "SELECT o_orderkey, trim(o_orderpriority) AS trimmed, substr(o_orderpriority, 3, 4) AS slice, instr(o_orderpriority, 'URG') > 0 AS holds FROM orders")
def fn1(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", segments.trimmed(F.concat(F.lit("  "), p, F.lit(" \t\n"))).alias("trimmed"), segments.sliced(p, 2, 4).alias("slice"), segments.is_segment(p, F.lit("URG")).alias("holds"))


@query("fn2_dates", "SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts) * 10 + 621355968000000000 AS ticks FROM events")
def fn2(spark: SparkSession, d: str) -> DataFrame:
    at = timekeys.to_micros("ts")
    return table(spark, d, "events").select("event_id", at.alias("micros"), (at * 10 + timekeys.EPOCH_DAYS * 864_000_000_000).alias("ticks"))


@query("fn3_time_zone", "SELECT event_id, epoch_us((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS local, epoch_us((ts AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC') AS utc FROM events")
def fn3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", timekeys.to_micros(timekeys.utc_to_zone(F.col("ts"), "nyse")).alias("local"), timekeys.to_micros(timekeys.zone_to_utc(F.col("ts"), "lse")).alias("utc"))


@query(
    "fn4_crc32c",
    """WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) AS v FROM range(256) r(i)))
    SELECT event_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(props) + 1), lambda i: ord(substr(props, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM events, t""",
)
def fn4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", hashes.crc32c(F.col("props")).alias("crc"))


@query("fn5_hashes", "SELECT event_id, sha256(props) AS sha, md5(props) AS md FROM events")
def fn5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.sha2("props", 256).alias("sha"), F.md5("props").alias("md"))


@query("fn5_xxhash", "SELECT event_id, true AS same, true AS seeded FROM events")
def fn5_xxhash(spark: SparkSession, d: str) -> DataFrame:
    """Spark's own hash and the library's agree on every row; another seed gives another hash, whose values for known bytes the tests have."""
    text = F.concat("props", F.col("event_id").cast("string"))
    library = hashes.xxh64(F.concat(text, F.lit("")), 43)
    return table(spark, d, "events").select("event_id", (hashes.xxh64(text) == F.xxhash64(text)).alias("same"), (library != hashes.xxh64(text)).alias("seeded"))


# The published digests of "abc", for 32 bytes of BLAKE2b and for XXH64 with the seed 0.
_ABC_BLAKE2B, _ABC_XXH64 = "bddd813c634239723171ef3fee98579b94964e3bb1cb3e427262c8c068d52319", 0x44BC2CF5AD770999


@query("fn5_known_digests", f"SELECT n_nationkey, '{_ABC_BLAKE2B}' AS blake, {_ABC_XXH64} AS xx FROM nation")
def fn5_known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", hashes.blake2b(F.lit("abc")).alias("blake"), hashes.xxh64(F.lit("abc"), 0).alias("xx"))


@query("fn5_blake2b")
def fn5_blake(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", hashes.blake2b(F.col("props")).alias("digest"))


@query("fn6_byte_equality", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON encode(a.n_name) = encode(b.n_name)")
def fn6(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.encode("n_name", "UTF-8").alias("b"))
    return n.select(F.col("n_nationkey").alias("x"), "b").join(n.select(F.col("n_nationkey").alias("y"), "b"), "b").select("x", "y")


@query("fn7_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def fn7(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return df.select("event_id", F.from_json(F.to_json("p"), "k bigint")["k"].alias("k"))


@query("fn8_array_values", "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(list_max(embedding::DOUBLE[]), 6) AS most, len(embedding) AS n FROM embeddings")
def fn8(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a), 6).alias("mean"), F.round(F.array_max(a), 6).alias("most"), F.size(a).cast("long").alias("n"))


@query("fn9_bits", "SELECT event_id, bit_count(event_id)::BIGINT AS ones, event_id > 0 AND (event_id & (event_id - 1)) = 0 AS power FROM events")
def fn9(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.bit_count(i).cast("long").alias("ones"), ((i > 0) & (i.bitwiseAND(i - 1) == 0)).alias("power"))


@query("udf1_scalar", "SELECT user_id, k, round(v * v + 1, 4) AS v FROM e")
def udf1(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.custom import vectorized

    return user_series(spark, d).map(lambda v: F.round(vectorized(lambda x: x * x + 1)(v), 4)).to_df()


@query("udf2_moving", "SELECT user_id, k, round(max(v) OVER f - min(v) OVER f, 4) AS v FROM e WINDOW f AS (PARTITION BY user_id ORDER BY k ROWS 4 PRECEDING) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) >= 5")
def udf2(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.custom import moving_fold

    lo_hi = moving_fold(user_series(spark, d), 5, F.struct(F.lit(1e300).alias("a"), F.lit(-1e300).alias("b")), lambda s, r: F.struct(F.least(s["a"], r["v"]).alias("a"), F.greatest(s["b"], r["v"]).alias("b")))
    return lo_hi.map(lambda s: F.round(s["b"] - s["a"], 4)).to_df()


class _Spread:
    """A user's online operator: the sum of a window's distances from 50."""

    def __init__(self):
        self.total = 0.0

    def add_right(self, k, v):
        self.total += abs(v - 50)

    def remove_left(self, k, v):
        self.total -= abs(v - 50)

    def value(self):
        return self.total


@query("udf2_online", "SELECT user_id, k, round(sum(abs(v - 50)) OVER (PARTITION BY user_id ORDER BY k ROWS 4 PRECEDING), 4) AS v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) >= 5")
def udf2_online(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.custom import moving_online

    return moving_online(user_series(spark, d), 5, _Spread).withColumn("v", rounded("v"))


class _Records:
    """A user's cursor: the rows whose value is greater than all before, and at the end how many rows there were."""

    def __init__(self):
        self.most, self.n, self.last = float("-inf"), 0, None

    def move(self, k, v):
        self.n, self.last = self.n + 1, k
        if v > self.most:
            self.most = v
            return [("record", k, v)]
        return []

    def end(self):
        return [("rows", self.last, float(self.n))]


@query(
    "udf3_cursor",
    """SELECT user_id, 'record' AS what, k, v FROM (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE before IS NULL OR v > before
    UNION ALL SELECT user_id, 'rows', max(k), count(*)::DOUBLE FROM e GROUP BY user_id""",
)
def udf3(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.custom import cursor

    return cursor(user_series(spark, d), _Records, "what string, k long, v double")
