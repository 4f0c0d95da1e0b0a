"""Known cases of the series algebra, and random ones against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, grid, moving, navigation, sets, summary
from tidemark.plans.frames import Frame, Lookup
from tidemark.series import OutOfOrderKeyError, ReadOnlyError, Series


def of(spark, d, schema="k long, v double"):
    return Series.from_pairs(spark, [(k, float(v)) for k, v in d.items()], schema)


def as_dict(s):
    return dict(map(tuple, s.to_df().collect()))


def at(s, spark, *keys):
    return dict(map(tuple, s.at(spark.createDataFrame([(k,) for k in keys], "k long")).collect()))


UPPER, LOWER = {2: 2, 4: 4}, {1: 10, 3: 30, 5: 50}


def test_upper_lower(spark):
    upper, lower = of(spark, UPPER), of(spark, LOWER)
    assert as_dict(upper + lower) == {}
    assert as_dict(upper.repeat() + lower) == {3: 32, 5: 54}
    assert as_dict(upper.repeat() + lower.fill(42.0)) == {2: 44, 3: 32, 4: 46, 5: 54}
    assert as_dict(upper.repeat(block=2) + lower.fill(42.0)) == {2: 44, 3: 32, 4: 46, 5: 54}


def test_fill(spark):
    s = of(spark, {1: 1, 3: 3, 5: 5}).fill(42.0)
    assert as_dict(s) == {1: 1, 3: 3, 5: 5} and s.is_continuous
    assert at(s, spark, 2, 0, 3) == {2: 42, 0: 42, 3: 3}
    found = [[r["v"] for r in navigation.try_find(s, 4, x).collect()] for x in (Lookup.LE, Lookup.GT, Lookup.EQ)]
    assert found == [[3.0], [5.0], []]
    assert s.fill(7.0) is s


def test_map_and_range(spark):
    s = of(spark, {1: 1})
    for n, want in ((1, 2), (2, 4), (3, 8)):
        x = s
        for _ in range(n):
            x = x.map(lambda v: v * 2)
        assert as_dict(x) == {1: want}
        assert as_dict(x.range(0, 2)) == {1: want}
    assert as_dict(Series.empty(spark).range(0, 100)) == {}


def test_count_windows(spark):
    s = of(spark, {k: k for k in range(100)})
    total = as_dict(s.windowed(Frame(count=10), total="sum"))
    assert total == {k: (2 * k - 9) / 2 * 10 for k in range(9, 100)}
    small = s.before(19)
    assert as_dict(small.windowed(Frame(count=10, incomplete=True), n="count")) == {k: min(k + 1, 10) for k in range(20)}
    assert as_dict(small.windowed(Frame(count=40, incomplete=True), n="count")) == {k: k + 1 for k in range(20)}


def test_width_windows_of_regular_keys(spark):
    s = of(spark, {k: k for k in range(1, 21)})
    sma = lambda **kw: as_dict(s.sma(**kw))
    assert sma(width=9, lookup=Lookup.LE) == sma(count=10, incomplete=True)
    assert sma(width=9, lookup=Lookup.LT) == sma(count=9, incomplete=True)
    assert sma(width=9, lookup=Lookup.GE) == sma(count=10)
    assert sma(width=9, lookup=Lookup.GT) == sma(count=11)
    with pytest.raises(ValueError):
        s.sma(width=9, lookup=Lookup.EQ)


def test_left_edges_of_irregular_keys(spark):
    s = of(spark, dict.fromkeys((0, 1, 2, 3, 50, 51, 52, 53, 54, 60, 61), 1))
    got = as_dict(s.windowed(Frame(width=3), left="first_key"))
    assert {(a, k) for k, a in got.items()} == {(0, 3), (3, 50), (3, 51), (3, 52), (50, 53), (51, 54), (54, 60), (54, 61)}


@pytest.mark.parametrize("lookup", [Lookup.LE, Lookup.LT, Lookup.GE, Lookup.GT])
def test_width_windows_of_random_keys(spark, lookup):
    rng = random.Random(lookup.name)
    keys = sorted(rng.sample(range(300), 90))
    d = {k: rng.randrange(100) for k in keys}
    w = 17
    want = {}
    for k in keys:
        if lookup in (Lookup.LE, Lookup.LT):
            lo = k - w if lookup is Lookup.LE else k - w + 1
        else:
            edge = [x for x in keys if (x <= k - w if lookup is Lookup.GE else x < k - w)]
            if not edge:
                continue
            lo = max(edge)
        v = [d[x] for x in keys if lo <= x <= k]
        mean = sum(v) / len(v)
        var = sum((x - mean) ** 2 for x in v) / (len(v) - 1) if len(v) > 1 else None
        want[k] = (sum(v), len(v), min(v), max(v), var, sorted(v)[len(v) // 2] if len(v) % 2 else (sorted(v)[len(v) // 2 - 1] + sorted(v)[len(v) // 2]) / 2)
    got = as_dict(of(spark, d).windowed(Frame(width=w, lookup=lookup), a="sum", b="count", c="min", d="max", e="var", f="median"))
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert tuple(got[k])[:4] == x[:4] and got[k]["f"] == pytest.approx(x[5])
        assert (got[k]["e"] is None) == (x[4] is None) and (x[4] is None or got[k]["e"] == pytest.approx(x[4], abs=1e-6))


def _value(d, kind, k):
    if kind == "discrete":
        return d.get(k)
    if kind == "fill":
        return d.get(k, 7)
    before = [x for x in d if x <= k]
    return d[max(before)] if before else None


@pytest.mark.parametrize("left", ["discrete", "fill", "repeat"])
@pytest.mark.parametrize("right", ["discrete", "fill", "repeat"])
def test_random_zips(spark, left, right):
    rng = random.Random(f"{left}/{right}")
    a, b = ({k: rng.randrange(50) for k in rng.sample(range(120), 40)} for _ in range(2))
    make = {"discrete": lambda s: s, "fill": lambda s: s.fill(7.0), "repeat": lambda s: s.repeat(block=rng.choice([None, 10]))}
    both = make[left](of(spark, a)) + make[right](of(spark, b))
    keys = a.keys() & b.keys() if left == right == "discrete" else a.keys() if left == "discrete" else b.keys() if right == "discrete" else a.keys() | b.keys()
    value = lambda k: (_value(a, left, k), _value(b, right, k))
    assert as_dict(both) == {k: sum(value(k)) for k in keys if None not in value(k)}
    probes = range(0, 130, 3)
    assert at(both, spark, *probes) == {k: sum(value(k)) for k in probes if None not in value(k)}


def test_lag(spark):
    s = of(spark, {k: k for k in range(1, 21)})
    assert as_dict(s.lag(1).map(lambda v: v["lagged"]["key"])) == {k: k - 1 for k in range(2, 21)}
    assert sorted(as_dict(s.lag(2, step=3))) == [3, 6, 9, 12, 15, 18]


def test_zip_n(spark):
    series = [of(spark, {i: i * n for i in range(20) if i != 1}) for n in (1, 2, 3)]
    assert as_dict(Series.zip_n(series, lambda k, a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y))) == {i: 6 * i for i in range(20) if i != 1}
    with pytest.raises(ValueError):
        Series.zip_n([], lambda k, a: a)


def test_division_and_modulo(spark):
    s = Series.from_pairs(spark, [(1, -7), (2, 7)], "k long, v long")
    assert as_dict(s / 2) == {1: -3, 2: 3}
    assert as_dict(s % 3) == {1: -1, 2: 1}
    assert as_dict(15 / s) == {1: -2, 2: 2}


def test_nan_compares_like_ieee(spark):
    s = Series.from_pairs(spark, [(1, float("nan")), (2, 1.0)])
    assert as_dict(s > 0) == {1: False, 2: True}
    assert as_dict(s == s) == {1: False, 2: True}
    assert as_dict(s != s) == {1: True, 2: False}


def test_order_and_mutability(spark):
    with pytest.raises(OutOfOrderKeyError):
        Series.from_pairs(spark, [(1, 1.0), (1, 2.0)])
    s = of(spark, {1: 1, 2: 2})
    with pytest.raises(Exception, match="OutOfOrderKey"):
        s.append(spark.createDataFrame([(2, 5.0)], "k long, v double")).to_df().collect()
    more = spark.createDataFrame([(2, 5.0), (3, 6.0), (3, 6.0)], "k long, v double")
    assert as_dict(s.append(more, on_conflict="skip")) == {1: 1, 2: 2, 3: 6}
    assert as_dict(s.upsert(more.where("k = 2"))) == {1: 1, 2: 5}
    with pytest.raises(ReadOnlyError):
        s.to_append_only().upsert(more)
    with pytest.raises(ReadOnlyError):
        s.to_readonly().append(more)
    with pytest.raises(Exception, match="OutOfOrderKey"):
        Series.of(more, "k", "v", check=True).to_df().collect()


def test_find_outside(spark):
    s = of(spark, {k: k for k in range(100)})
    assert [r["found"] for r in navigation.try_find(s, -100, Lookup.GE).collect()] == [0]
    assert navigation.try_find(s, -100, Lookup.LE).collect() == []


def test_key_types_must_agree(spark):
    a = of(spark, {1: 1})
    b = Series.from_pairs(spark, [("x", 1.0)], "k string, v double")
    with pytest.raises(TypeError):
        a + b


def test_grids(spark):
    p = grid.Parameter(0, 19, 5)
    assert [p.value(i) for i in range(p.steps)] == [0, 5, 10, 15, 19]
    region = p.region(2, 1)
    assert [region.value(i) for i in range(region.steps)] == [5, 10, 15]
    g = grid.Grid({"a": grid.Parameter(0, 4, 1), "b": grid.Parameter(0, 4, 1)})
    assert [g.address(x) for x in ([1, 0], [1, 1], [4, 3])] == [5, 6, 23]
    assert g.position(23) == [4, 3]
    target = lambda a, b: -((a - 3) * (a - 3) + (b - 1) * (b - 1))
    assert tuple(grid.maximize(spark, g, target).head()) == (3, 1, 0)


def test_holes_in_bars(spark):
    rows = spark.createDataFrame([(250_000, 1.0, 1), (750_000, 2.0, 2), (2_500_000, 3.0, 3)], "k long, p double, q long")
    got = {r["slice"]: tuple(r)[1:] for r in bars.ohlcv(rows, "k", "p", "q", "second").collect()}
    assert got == {0: (1.0, 2.0, 1.0, 2.0, 3), 2_000_000: (3.0, 3.0, 3.0, 3.0, 3)}


def test_blocks_give_the_same_running_sums(spark):
    s = of(spark, {k * k: k for k in range(40)})
    assert sorted(map(tuple, summary.cumulative(s).collect())) == sorted(map(tuple, summary.cumulative(s, block=100).collect()))


def test_blocks_give_the_same_windows(spark):
    rng = random.Random(7)
    keys = {p: sorted(rng.sample(range(60), 20) + rng.sample(range(400, 430), 9) + [900]) for p in ("a", "b", None)}
    df = spark.createDataFrame([(p, k, float(rng.randrange(9))) for p, own in keys.items() for k in own], "p string, k long, v double")
    panel, alone = Series.of(df, "k", "v", ("p",)), Series.of(df.where("p = 'a'"), "k", "v")
    for s in (panel, alone):
        rows = lambda x: sorted(map(repr, x.to_df().collect()))
        for frame in [{"count": 4}, {"count": 4, "incomplete": True}, *({"width": 7, "lookup": x} for x in Lookup if x is not Lookup.EQ)]:
            whole, cut = (rows(s.windowed(Frame(**frame, block=b), n="count", total="sum", first="first_key", mid="median")) for b in (None, 8))
            assert whole and whole == cut, frame
        for n, step in ((1, 1), (3, 2)):
            assert rows(s.lag(n, step)) == rows(s.lag(n, step, block=5))
    with pytest.raises(ValueError):
        Frame(count=4, block=3)
    with pytest.raises(ValueError):
        panel.lag(3, block=3)


def test_ranks(spark):
    df = spark.createDataFrame([([3.0, 1.0, 3.0, 2.0],), ([5.0],)], "a array<double>").select(moving.rank_array(F.col("a")))
    assert [r[0] for r in df.collect()] == [[2, 0, 3, 1], [0]]


def test_key_sets(spark):
    a, b = of(spark, {1: 1, 2: 2}), of(spark, {2: 2, 3: 3})
    keys = lambda df: sorted(r["k"] for r in df.collect())
    assert (keys(sets.union_keys(a, b)), keys(sets.common_keys(a, b)), keys(sets.missing_keys(a, b))) == ([1, 2, 3], [2], [1])


def test_null_values_are_not_missing(spark):
    s = Series.from_pairs(spark, [(1, 1.0), (3, None)])
    assert at(s.repeat(), spark, 2, 4) == {2: 1.0, 4: None}
    assert at(s.fill(9.0), spark, 3, 4) == {3: None, 4: 9.0}


def test_regression_on_several_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(60), rng.normal(size=(60, 2))])
    y = 0.33 + 0.25 * x[:, 1] + 1.5 * x[:, 2] + rng.normal(size=60) * 0.1
    rows = [(i, (float(b), [float(v) for v in a])) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    s = Series.of(spark.createDataFrame(rows, "k long, v struct<y:double,x:array<double>>"), "k", "v")
    got = {r["k"]: r["beta"] for r in moving.regression_many(s, 3, 20, 7).collect()}
    assert sorted(got) == [19, 26, 33, 40, 47, 54]
    for k, beta in got.items():
        want = np.linalg.lstsq(x[k - 19 : k + 1], y[k - 19 : k + 1], rcond=None)[0]
        assert beta == pytest.approx(list(want), abs=1e-8)


def test_lookups_and_interpolation_are_not_quadratic(spark):
    import time

    from pyspark.sql import functions as F

    from tidemark.operators import navigation as nav
    from tidemark.plans.frames import Lookup

    s = Series.of(spark.range(400_000).select((F.col("id") * 2).alias("k"), F.col("id").cast("double").alias("v")), "k", "v")
    probes = spark.range(400_000).select((F.col("id") * 2 - 1).alias("k"))
    for lookup, off in ((Lookup.GE, 1), (Lookup.GT, 1), (Lookup.LE, -1), (Lookup.LT, -1)):
        begun = time.perf_counter()
        out = nav.find_many(s, probes, lookup)
        assert out.where(F.col("found") != F.col("probe") + off).count() == 0 and out.count() >= 399_999
        assert time.perf_counter() - begun < 60
    begun = time.perf_counter()
    assert s.interpolate().at(probes).where(F.abs(F.col("v") * 2 - F.col("k")) > 1e-6).count() == 0
    assert time.perf_counter() - begun < 60


def test_late_rows_fail_a_stream_that_says_so(spark):
    from tidemark.streaming import running, stateful

    make = lambda rows: spark.createDataFrame(rows, "p int, k long, v double")
    steps = [make([(1, 5, 1.0), (1, 6, 2.0)]), make([(1, 6, 3.0)])]
    with pytest.raises(Exception, match="(?s)OutOfOrderError|StreamingQueryException"):
        running.stepped(spark, steps, lambda live: stateful.moving_mean(live, "p", 1, late="fail"), "fails")
    kept = running.stepped(spark, steps, lambda live: stateful.moving_mean(live, "p", 1), "drops")
    assert sorted((r["k"], r["v"]) for r in kept.collect()) == [(5, 1.0), (6, 2.0)]


def test_streams_of_awkward_series(spark, monkeypatch):
    from tidemark.streaming import running, stateful

    monkeypatch.setattr(stateful, "GROUPS", 1, raising=False)
    make = lambda rows, kind: spark.createDataFrame(rows, f"p {kind}, k long, v double")
    for kind, x in (("long", 2**62 + 1), ("string", "a"), ("double", 0.1), ("binary", b"\xff")):
        steps = [make([(x, 5, 1.0), (None, 4, 2.0), (x, 5, 1.0)], kind), make([(None, 3, 3.0), (None, 6, 4.0), (x, 7, 3.0)], kind)]
        means = running.stepped(spark, steps, lambda live: stateful.moving_mean(live, "p", 2), "awkward")
        assert sorted(map(repr, map(tuple, means.collect()))) == sorted(map(repr, [(x, 7, 2.0), (None, 6, 3.0)]))


def test_answers_that_came_too_early_fail(spark):
    from tidemark.streaming import running, stateful

    make = lambda rows: spark.createDataFrame(rows, "p int, k long, v double, side string")
    steps = [make([(1, 1, 7.0, "r"), (1, 5, 1.0, "l")]), make([(1, 3, 9.0, "r")])]
    with pytest.raises(Exception, match="(?s)OutOfOrderError|StreamingQueryException"):
        running.stepped(spark, steps, lambda live: stateful.carried(live, "p"), "early")


def test_only_new_files_are_streamed(spark, tmp_path):
    import os
    import time

    from tidemark.streaming import running

    path = f"{tmp_path}/rows"
    spark.range(5).write.parquet(path)
    old = time.time() - 3600
    for name in os.listdir(path):
        os.utime(f"{path}/{name}", (old, old))
    live = running.source(spark, f"file://{path}", new_only=True)
    spark.range(100, 103).write.mode("append").parquet(path)
    assert sorted(r["id"] for r in running.drained(live, "new").collect()) == [100, 101, 102]
