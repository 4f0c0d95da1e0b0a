"""Sources, navigation, projection, filters, ranges, arithmetic and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market, numeric, timekeys
from ..operators import navigation as nav
from ..plans.frames import Lookup
from ..series import Series
from ..sources import generators
from . import daily_orders, events, query, rounded, table, user_series

HOUR, DAY = 3_600_000_000, 86_400_000_000
MID = "(SELECT (min(k) + max(k)) // 2 FROM e)"


def _mid(s: Series) -> F.Column:
    """The middle of all keys, as a scalar subquery."""
    return s.to_df().agg(F.expr("(min(k) + max(k)) div 2")).scalar()


@query("src1_from_pairs", "SELECT 1000 - 3 * i AS k, 0.25 * i AS v FROM range(500) t(i)")
def src1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Series.from_pairs(spark, [(1000 - 3 * i, 0.25 * i) for i in range(500)]).to_df()


@query("src1_from_rows", "SELECT user_id, k, v FROM e")
def src1(spark: SparkSession, d: str) -> DataFrame:
    return Series.of(events(spark, d), "k", "v", ("user_id",), check=True).to_df()


@query("src2_empty", "SELECT k, v FROM (SELECT 1::BIGINT AS k, 1.0::DOUBLE AS v) WHERE k > 1")
def src2(spark: SparkSession, d: str) -> DataFrame:
    return Series.empty(spark).to_df()


@query("src3_constant", "SELECT user_id, k, 42.0::DOUBLE AS v FROM e WHERE event_type = 'purchase'")
def src3(spark: SparkSession, d: str) -> DataFrame:
    keys = events(spark, d, "event_type").where("event_type = 'purchase'").select("user_id", "k")
    return Series.constant(42.0, user_series(spark, d)).at(keys)


@query("src4_readonly", "SELECT user_id, k, v FROM e")
def src4(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).to_readonly().to_df()


@query("src5_dummy_series", "SELECT 100 + 3 * i AS k, 5.0 + 0.5 * i AS v FROM range(10000) t(i)")
def src5(spark: SparkSession, d: str) -> DataFrame:
    return generators.dummy_series(spark, 10_000, 100, 3, 5.0, 0.5).to_df()


@query("src6_dummy_wide", "SELECT i AS k, c::INT AS col, (1.0 + i) * power(2.0, c) AS v FROM range(2000) t(i), range(5) u(c)")
def src6(spark: SparkSession, d: str) -> DataFrame:
    return generators.dummy_wide(spark, 2_000, 5, 0, 1, 1.0, 1.0, 2.0)


@query("src7_random_walk")
def src7(spark: SparkSession, d: str) -> DataFrame:
    return generators.random_walk(spark, 10_000, seed=7).to_df()


@query("src10_mutability", "SELECT 'readonly' AS tightened, true AS refused")
def src10(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d).to_append_only().to_readonly().to_append_only()
    try:
        s.append(s.to_df())
        refused = False
    except TypeError:
        refused = True
    return spark.range(1).select(F.lit(s.mutability).alias("tightened"), F.lit(refused).alias("refused"))


@query("nav1_first_last", "SELECT user_id, min(k) AS first_key, arg_min(v, k) AS first_value, max(k) AS last_key, arg_max(v, k) AS last_value FROM e GROUP BY user_id")
def nav1(spark: SparkSession, d: str) -> DataFrame:
    return nav.first_last(user_series(spark, d))


@query("nav2_keys_values", "SELECT user_id, 'key' AS kind, k::DOUBLE AS x FROM e UNION ALL SELECT user_id, 'value', v FROM e")
def nav2(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d)
    keys = nav.keys(s).select("user_id", F.lit("key").alias("kind"), F.col("k").cast("double").alias("x"))
    return keys.unionByName(nav.values(s).select("user_id", F.lit("value").alias("kind"), F.col("v").alias("x")))


@query("nav3_item", "SELECT user_id, k, v FROM e WHERE event_id = (SELECT max(event_id) FROM events)")
def nav3(spark: SparkSession, d: str) -> DataFrame:
    top = events(spark, d, "event_id").orderBy(F.desc("event_id")).limit(1).select("user_id", "k")
    return nav.item(user_series(spark, d), top)


@query("nav4_try_get", f"SELECT user_id, arg_max(v, k) AS v FROM e WHERE k <= {MID} GROUP BY user_id")
def nav4(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d)
    keys = s.to_df().select("user_id").distinct().withColumn("k", _mid(s))
    return s.repeat().at(keys).select("user_id", "v")


@query(
    "nav5_try_find",
    f"""SELECT user_id, 'LT' AS lookup, max(k) AS found, arg_max(v, k) AS v FROM e WHERE k < {MID} GROUP BY user_id
    UNION ALL SELECT user_id, 'LE', max(k), arg_max(v, k) FROM e WHERE k <= {MID} GROUP BY user_id
    UNION ALL SELECT user_id, 'EQ', max(k), arg_max(v, k) FROM e WHERE k = {MID} GROUP BY user_id
    UNION ALL SELECT user_id, 'GE', min(k), arg_min(v, k) FROM e WHERE k >= {MID} GROUP BY user_id
    UNION ALL SELECT user_id, 'GT', min(k), arg_min(v, k) FROM e WHERE k > {MID} GROUP BY user_id""",
)
def nav5(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d)
    at = _mid(s)
    parts = [nav.try_find(s, at, x).select("user_id", F.lit(x.name).alias("lookup"), "found", "v") for x in (Lookup.LT, Lookup.LE, Lookup.EQ, Lookup.GE, Lookup.GT)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("nav5_try_find_many", "SELECT p.user_id, p.k AS probe, max(e.k) AS found, arg_max(e.v, e.k) AS v FROM (SELECT user_id, k FROM e WHERE event_type = 'view') p JOIN e ON e.user_id = p.user_id AND e.k < p.k GROUP BY 1, 2")
def nav5_many(spark: SparkSession, d: str) -> DataFrame:
    probes = events(spark, d, "event_type").where("event_type = 'view'").select("user_id", "k")
    return nav.find_many(user_series(spark, d), probes, Lookup.LT)


def _find_many(name: str, side: str, nearest: str, lookup: Lookup) -> None:
    sql = f"SELECT p.user_id, p.k AS probe, {nearest}(e.k) AS found, arg_{nearest}(e.v, e.k) AS v FROM (SELECT user_id, k + 1 - event_id % 3 AS k FROM e WHERE event_type = 'view') p JOIN e ON e.user_id = p.user_id AND e.k {side} p.k GROUP BY 1, 2"

    @query(f"nav5_try_find_many_{name}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        probes = events(spark, d, "event_type", "event_id").where("event_type = 'view'").select("user_id", (F.col("k") + 1 - F.col("event_id") % 3).alias("k"))
        return nav.find_many(user_series(spark, d), probes, lookup)


for _name, _side, _nearest in (("le", "<=", "max"), ("eq", "=", "max"), ("ge", ">=", "min"), ("gt", ">", "min")):
    _find_many(_name, _side, _nearest, Lookup[_name.upper()])


@query("nav6_try_get_at", "SELECT user_id, k, v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) = 4")
def nav6(spark: SparkSession, d: str) -> DataFrame:
    return nav.get_at(user_series(spark, d), 3)


@query("nav7_move_stride", "SELECT user_id, k, v FROM e QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY k) - 1) % 5 = 0")
def nav7(spark: SparkSession, d: str) -> DataFrame:
    return nav.stride(user_series(spark, d), 5)


@query(
    "nav7_move_stride_back_partial",
    """SELECT user_id, k, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e) WHERE i % 4 = 0 OR i = n - 1""",
)
def nav7_back(spark: SparkSession, d: str) -> DataFrame:
    return nav.stride(user_series(spark, d), -4, allow_partial=True)


@query("nav8_iterate", "SELECT user_id, k, v, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS forward, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) - 1 AS backward FROM e")
def nav8(spark: SparkSession, d: str) -> DataFrame:
    return nav.positions(user_series(spark, d))


@query("nav9_position", f"SELECT user_id, k, v FROM e WHERE k >= {MID}")
def nav9(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d)
    return nav.subscribe(s, "at_or_after", _mid(s)).to_df()


#: A key that is there: the last purchase of all.
_AT = "(SELECT max(k) FROM e WHERE event_type = 'purchase')"


@query(
    "nav9_all_positions",
    f"""SELECT position, count(e.k) AS n, coalesce(min(e.k), 0) AS first_key, coalesce(max(e.k), 0) AS last_key FROM e RIGHT JOIN (VALUES ('first'), ('last'), ('new_only'), ('at'), ('after'), ('before'), ('at_or_after'), ('at_or_before')) p(position)
    ON CASE position WHEN 'first' THEN true WHEN 'last' THEN (e.user_id, e.k) IN (SELECT (user_id, max(k)) FROM e GROUP BY user_id) WHEN 'new_only' THEN false
    WHEN 'at' THEN e.k = {_AT} WHEN 'after' THEN e.k > {_AT} WHEN 'before' THEN e.k < {_AT} WHEN 'at_or_after' THEN e.k >= {_AT} ELSE e.k <= {_AT} END GROUP BY 1""",
)
def nav9_all(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d)
    key = events(spark, d, "event_type").where("event_type = 'purchase'").agg(F.max("k")).scalar()
    out = None
    for position in ("first", "last", "new_only", "at", "after", "before", "at_or_after", "at_or_before"):
        one = nav.subscribe(s, position, key).to_df().agg(F.lit(position).alias("position"), F.count("k").alias("n"), F.coalesce(F.min("k"), F.lit(0)).alias("first_key"), F.coalesce(F.max("k"), F.lit(0)).alias("last_key"))
        out = one if out is None else out.unionByName(one)
    return out


@query("nav10_metadata", "SELECT count(*) AS row_count, count(*) = 0 AS is_empty, false AS is_continuous FROM e")
def nav10(spark: SparkSession, d: str) -> DataFrame:
    return nav.metadata(user_series(spark, d))


@query("nav12_key_range_lookup", "SELECT l_orderkey AS k, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200 GROUP BY 1")
def nav12(spark: SparkSession, d: str) -> DataFrame:
    rows = Series.of(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", sorting="weak").range(100, 200)
    return rows.to_df().groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query("map1_map_value", "SELECT user_id, k, round(v * 2, 6) AS v FROM e")
def map1(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).map(lambda v: F.round(v * 2, 6)).to_df()


@query("map2_map_pair", "SELECT user_id, k, round(v + k % 1000, 6) AS v FROM e")
def map2(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).map_pairs(lambda k, v: F.round(v + k % 1000, 6)).to_df()


@query("map3_map_chain", "SELECT user_id, k, round((v * 2 + 1) * 3 - 5, 6) AS v FROM e")
def map3(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).map(lambda v: v * 2).map(lambda v: v + 1).map(lambda v: v * 3).map(lambda v: F.round(v - 5, 6)).to_df()


@query("map4_key_view", "SELECT k + 10 AS k, v FROM o")
def map4(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).map_keys(lambda k: k + 10, lambda k: k - 10).to_df()


@query("flt1_filter_value", "SELECT user_id, k, v FROM e WHERE v > 50")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).filter(lambda v: v > 50).to_df()


@query("flt2_filter_key", "SELECT user_id, k, v FROM e WHERE k % 2 = 0")
def flt2(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).filter_keys(lambda k: k % 2 == 0).to_df()


@query("flt3_filter_pair", "SELECT user_id, k, v FROM e WHERE v > k % 100")
def flt3(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).filter_pairs(lambda k, v: v > k % 100).to_df()


@query("rng1_range", "SELECT k, v FROM o WHERE k > 9000 AND k <= 9500")
def rng1(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).range(9000, 9500, start_incl=False).to_df()


@query("rng2_after", "SELECT k, v FROM o WHERE k >= 9500")
def rng2(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).after(9500).to_df()


@query("rng3_before", "SELECT k, v FROM o WHERE k < 9300")
def rng3(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).before(9300, incl=False).to_df()


@query("rng4_range_merge", "SELECT k, v FROM o WHERE k >= 8800 AND k <= 9200")
def rng4(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).range(8500, 9200).range(8800, 9900).to_df()


@query("rng5_range_under_map", "SELECT k, round(v / 2, 4) AS v FROM o WHERE k >= 9200 AND k <= 9400")
def rng5(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d).map(lambda v: F.round(v / 2, 4)).range(9200, 9400).to_df()


def _scalar(name: str, sql: str, f) -> None:
    @query(name, f"SELECT user_id, k, {sql} AS v FROM e")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(user_series(spark, d)).map(rounded).to_df()


_scalar("ari1_add", "round(v + 3, 4)", lambda s: s + 3)
_scalar("ari2_subtract", "round(v - 3, 4)", lambda s: s - 3)
_scalar("ari3_subtract_from", "round(3 - v, 4)", lambda s: 3 - s)
_scalar("ari4_multiply", "round(v * 3, 4)", lambda s: s * 3)
_scalar("ari5_divide", "round(v / 4, 4)", lambda s: s / 4)
_scalar("ari6_divide_into", "round(4 / (v + 1), 4)", lambda s: 4 / (s + 1))
_scalar("ari9_negate", "round(-v, 4)", lambda s: -s)
_scalar("ari10_plus", "round(v, 4)", lambda s: +s)


def _whole(name: str, sql: str, f) -> None:
    @query(name, f"SELECT l_orderkey AS k, {sql} AS v FROM (SELECT l_orderkey, l_linenumber - 4 AS n, l_partkey AS p FROM lineitem)")
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 4).alias("n"), F.col("l_partkey").alias("p"))
        return f(rows).to_df()


_whole("ari5_divide_whole", "((p - 500) // 7)::BIGINT", lambda df: Series.of(df.withColumn("q", F.col("p") - 500), "l_orderkey", "q", sorting="weak") / 7)
_whole("ari7_modulo", "(n % 3)::INT", lambda df: Series.of(df, "l_orderkey", "n", sorting="weak") % 3)
_whole("ari8_modulo_into", "(17 % (n + 5))::INT", lambda df: 17 % (Series.of(df, "l_orderkey", "n", sorting="weak") + 5))


@query("ari11_opposite_sign", "SELECT user_id, k, sign(v - 50) * sign(25 - v) < 0 AS v FROM e")
def ari11(spark: SparkSession, d: str) -> DataFrame:
    return user_series(spark, d).map(lambda v: numeric.opposite_sign(v - 50, 25 - v)).to_df()


@query("ari12_to_double", "SELECT l_orderkey AS k, l_linenumber::DOUBLE AS v FROM lineitem")
def ari12(spark: SparkSession, d: str) -> DataFrame:
    return Series.of(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", sorting="weak").map(numeric.to_double).to_df()


@query("ari13_variant", "SELECT event_id, ((props->>'k')::BIGINT * 2 + 1)::BIGINT AS v FROM events")
def ari13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (numeric.variant_number(F.parse_json("props"), "$.k", "bigint") * 2 + 1).alias("v"))


@query("ari14_decimal", "SELECT o_orderkey, (o_totalprice::DECIMAL(12, 2) * 1.05::DECIMAL(3, 2))::DECIMAL(16, 4)::DOUBLE AS v, (o_totalprice::DECIMAL(12, 2) > 100000) AS big FROM orders")
def ari14(spark: SparkSession, d: str) -> DataFrame:
    price = numeric.small_decimal("o_totalprice", 12, 2)
    return table(spark, d, "orders").select("o_orderkey", (price * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(16,4)").cast("double").alias("v"), (price > 100000).alias("big"))


@query("ari15_timestamp", "SELECT event_id, epoch_us(ts) * 1000 AS nanos, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 1000 AS since FROM events")
def ari15(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", timekeys.to_nanos("ts").alias("nanos"))
    return df.withColumn("since", F.col("nanos") - df.agg(F.min("nanos")).scalar())


def _compare(name: str, sql: str, f) -> None:
    @query(name, f"SELECT user_id, k, {sql} AS v FROM e")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(user_series(spark, d)).to_df()


_compare("cmp1_less", "v < 30", lambda s: s < 30)
_compare("cmp2_less_equal", "v <= 30", lambda s: s <= 30)
_compare("cmp3_greater", "v > 30", lambda s: s > 30)
_compare("cmp4_greater_equal", "v >= 30", lambda s: s >= 30)
_compare("cmp5_equal", "round(v, 0) = 30", lambda s: s.map(lambda v: F.round(v, 0)) == 30)
_compare("cmp6_not_equal", "round(v, 0) <> 30", lambda s: s.map(lambda v: F.round(v, 0)) != 30)


@query("cmp_series", "SELECT a.user_id, a.k, a.v < b.v AS v FROM e a JOIN (SELECT user_id, k, 100 - v AS v FROM e) b ON a.user_id = b.user_id AND a.k = b.k")
def cmp_series(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d)
    return (s < 100 - s).to_df()


@query("nav11_binary_search", "SELECT p.user_id, p.k AS probe, (CASE WHEN bool_or(e.k = p.k) THEN count(*) FILTER (e.k < p.k) ELSE -count(*) FILTER (e.k < p.k) - 1 END)::INT AS place FROM (SELECT user_id, k + k % 2 AS k FROM e WHERE event_type = 'signup') p JOIN e ON e.user_id = p.user_id GROUP BY 1, 2")
def nav11(spark: SparkSession, d: str) -> DataFrame:
    arrays = user_series(spark, d).to_df().groupBy("user_id").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    probes = events(spark, d, "event_type").where("event_type = 'signup'").select("user_id", (F.col("k") + F.col("k") % 2).alias("probe")).distinct()
    return probes.join(arrays, "user_id").select("user_id", "probe", nav.array_index(F.col("keys"), F.col("probe")).alias("place"))


@query("str10_monotone_time", f"WITH i AS (SELECT user_id, event_id, k // {HOUR} AS h, row_number() OVER (PARTITION BY user_id ORDER BY k) AS i FROM e) SELECT event_id, i + max(h - i) OVER (PARTITION BY user_id ORDER BY i) AS unique_time FROM i")
def str10(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d, "event_id").withColumn("h", F.floor(F.col("k") / HOUR))
    return timekeys.monotone(rows, "h", ["user_id"], ["k"]).select("event_id", "unique_time")


@query("mkt1_tick", "SELECT event_id, value::DECIMAL(18, 6)::DOUBLE AS price, (value * 100)::BIGINT AS money FROM events WHERE value > 0")
def mkt1(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").where("value > 0").select("event_id", market.tick(F.col("ts"), F.col("value"), F.lit(100)).alias("t"))
    return df.select("event_id", F.col("t.price").cast("double").alias("price"), F.round(market.money_volume(F.col("t.price"), F.col("t.volume"))).cast("long").alias("money"))
