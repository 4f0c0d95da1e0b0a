"""Mixing sources to target weights, with exact block quotas for every output shard."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, Cut, small

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Blocks that each source's permuted documents are dealt into, and shards that the mix is written to.
BLOCKS = 1024
SHARDS = 32
SEED = 20240


def n_words() -> F.Column:
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"[{WS}]+"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: one row per source.

    Sources in code point order, null last, weigh 5, 2, 1 and so on, and share the whole size. A target stops at
    three times its source's size; the excess goes to the others by weight. That is a water level L with targets
    min(L * weight, cap): sorted by cap over weight, the sources that stop are a prefix, and the level after each
    prefix follows from two running sums.
    """
    cap = MAX_REPEATS * F.col("source_size")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.encode("source", "UTF-8").asc_nulls_last())
    out = sizes.withColumn("rank", F.row_number().over(ordered)).withColumn("weight", w.cast("double"))
    by_ratio = everything.orderBy(cap / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "capped": F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    out = out.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    # the first source in that order that does not stop gives the level; if all stop, targets are the caps
    out = out.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(cap / F.col("weight"), "rank"))).over(everything))
    return out.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), cap.cast("double")), cap.cast("double")).alias("target"))


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, without replacement, are among the ``good``. By inversion from the mode outwards."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    lf = math.lgamma
    choose = lambda n, k: lf(n + 1) - lf(k + 1) - lf(n - k + 1)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    left = rng.random() - p
    up = down = mode
    pu = pd = p
    while left > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= pu
            if left <= 0:
                return up
        if down > low:
            pd *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= pd
            if left <= 0:
                return down
    return mode


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Exact block quotas by shard and source: a binary tree over the shards.

    At each node the left half of the shards gets its share of all the node's blocks, and how many of them come
    from each source is a multivariate hypergeometric draw, source by source from what is left.
    """
    out: list[list[int]] = [[] for _ in range(shards)]

    def go(first: int, n: int, own: list[int]) -> None:
        if n == 1:
            out[first] = own
            return
        rng, half, total = random.Random(f"{seed}/{first}/{n}"), n // 2, sum(own)
        take, rest, left = total * half // n, total, []
        for q in own:
            x = hypergeometric(rng, q, rest - q, take)
            left.append(x)
            take, rest = take - x, rest - q
        go(first, half, left)
        go(first + half, n - half, [a - b for a, b in zip(own, left, strict=True)])

    go(0, shards, list(quotas))
    return out


def _salt(seed: int, n: int, *cols: F.Column) -> F.Column:
    return F.xxhash64(F.lit(seed), F.lit(n), *cols)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the hidden columns that a plan is matched by: source, block, and the order within a block."""
    out = docs.withColumn("_t", F.xxhash64("text")).withColumn("_s", F.col("source").cast("string"))
    out = out.withColumn("_b", F.pmod(_salt(seed, 1, F.col("doc_id"), F.col("_t")), F.lit(BLOCKS)).cast("int"))
    return out.withColumn("_o", F.struct(_salt(seed, 3, F.col("doc_id"), F.col("_t")).alias("h"), F.col("doc_id").cast("string").alias("d"), F.col("_t").alias("t"))).drop("_t")


def _plan(spark: SparkSession, rows: DataFrame, cut: Cut, shards: int, seed: int) -> DataFrame:
    """Of each source and block: its shard in each pass that takes it, and at the source's edge the last document in order that is taken.

    ``rows(_s, _b, _o, size)``. At most ``BLOCKS`` rows per source.
    """
    blocks = cut(rows.groupBy("_s", "_b").agg(F.sum("size").alias("block_size")))
    sources = targets(blocks.groupBy(F.col("_s").alias("source")).agg(F.sum("block_size").alias("source_size")))
    # whole passes over a source, then its permuted blocks while they fit; the block at the edge gives single documents
    own = Window.partitionBy("_s").orderBy(_salt(seed, 2, F.col("_s"), F.col("_b")), "_b")
    blocks = blocks.join(sources, blocks["_s"].eqNullSafe(sources["source"])).drop("source")
    passes = F.least(F.lit(MAX_REPEATS), F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0)) + 1e-12)).cast("int")
    blocks = blocks.withColumns({"passes": passes, "place": F.row_number().over(own) - 1, "after": F.sum("block_size").over(own)})
    left = F.when(F.col("passes") < MAX_REPEATS, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0.0))
    blocks = blocks.withColumn("room", left - (F.col("after") - F.col("block_size")))
    edge = (F.col("room") > 0) & (F.col("room") < F.col("block_size"))
    full = (F.col("block_size") > 0) & (F.col("room") >= F.col("block_size"))
    blocks = cut(blocks.withColumn("edge", edge).withColumn("draws", F.col("passes") + (edge | full).cast("int")).drop("after"))
    # of the edge's documents, in permuted order, as many as come nearest to the room left: a 1/BLOCKS part of a source
    at = blocks.where("edge").select(F.col("_s").alias("s"), F.col("_b").alias("b"), "room")
    at = rows.join(at, F.col("_s").eqNullSafe(F.col("s")) & (F.col("_b") == F.col("b")))
    at = at.withColumn("sum", F.sum("size").over(Window.partitionBy("s", "b").orderBy("_o").rangeBetween(Window.unboundedPreceding, 0)))
    last = at.where(F.col("sum") - F.col("size") / 2 <= F.col("room")).groupBy("s", "b").agg(F.max("_o").alias("last"))
    # the splitting tree gives each shard an exact number of each source's draws
    per = [(r[0], r[1]) for r in blocks.groupBy("_s").agg(F.sum("draws")).orderBy(F.encode("_s", "UTF-8").asc_nulls_last()).collect()]  # one row per source
    quotas, dealt = split_quotas([d for _, d in per], shards, seed), []
    for i, (source, _) in enumerate(per):
        end = 0
        for shard in range(shards):
            begin, end = end, end + quotas[shard][i]
            dealt.append({"s": source, "k": shard, "begin": begin, "end": end})
    dealt = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(dealt)), "array<struct<s:string,k:int,begin:long,end:long>>")))
    # a shard's draws are the next in turn: pass after pass, each through the permuted blocks
    turn = F.row_number().over(Window.partitionBy("_s").orderBy("pass", "place")) - 1
    draws = blocks.where("draws > 0").select("_s", "_b", "place", F.explode(F.expr("sequence(0, draws - 1)")).alias("pass")).withColumn("turn", turn)
    draws = draws.join(dealt, F.col("_s").eqNullSafe(F.col("s")) & (F.col("turn") >= F.col("begin")) & (F.col("turn") < F.col("end")))
    dealt = draws.groupBy(F.col("_s").alias("s"), F.col("_b").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "k"))), lambda x: x["k"]).alias("mix_shards"))  # at most MAX_REPEATS
    out = blocks.select("_s", "_b", "source_size", "target", "edge")
    for more in (dealt, last):
        out = out.join(more, F.col("_s").eqNullSafe(F.col("s")) & (F.col("_b") == F.col("b")), "left").drop("s", "b")
    return small(cut(out.select(F.col("_s").alias("ps"), F.col("_b").alias("pb"), "source_size", "target", "edge", F.coalesce("mix_shards", F.array().cast("array<int>")).alias("mix_shards"), "last")))


def _applied(docs: DataFrame, plan: DataFrame) -> DataFrame:
    out = docs.join(plan, F.col("_s").eqNullSafe(F.col("ps")) & (F.col("_b") == F.col("pb")))
    whole = ~F.col("edge") | F.coalesce(F.col("_o") <= F.col("last"), F.lit(False))
    shards = F.when(whole, F.col("mix_shards")).otherwise(F.slice("mix_shards", F.lit(1), F.greatest(F.size("mix_shards") - 1, F.lit(0))))
    return out.withColumn("mix_shards", shards)


def mix_sources(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document, and into which shards: ``doc_id, source, size, source_size, target, taken, block, mix_shards``.

    ``block`` is the permuted block of its source that a document is in, and ``mix_shards`` the shards that the
    splitting tree sends it to, one for each time that it is taken.

    Every document is one row, also those that the mix leaves out. Size is the number of words (null text: 0).
    Sources, null among them, are ordered and weighed as ``targets`` says. A document is taken as often as whole
    passes over its source fit into the target, and once more if its permuted block, or at the edge the document
    itself, still fits; so a source's words miss its target by about half a document, and none is taken more than
    three times. A source without words has the target 0. Draws depend on doc_id, text and seed alone, so reruns
    agree; rows equal in both are taken alike. Columns besides doc_id, text and source are ignored; an empty
    table gives no rows.

    Rows without texts are joined with the plan by source and block, of which a source has ``BLOCKS``, so no
    source is gathered in one task; a plan that is counted and small is broadcast. Sources are the named parts of a mix: one row of each is in one task to
    share the total, and on the driver to draw quotas.
    """
    cut = Cut(spark, "mixing")
    rows = cut(_keyed(docs.select("doc_id", "text", "source"), seed).withColumn("size", n_words()).drop("text"))
    out = _applied(rows, _plan(spark, rows, cut, shards, seed))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.size("mix_shards") * F.col("size")).cast("long").alias("taken"), F.col("_b").alias("block"), "mix_shards")


def mixed_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken, and ``mix_shard`` and ``mix_order``.

    ``mix_order`` is a hash by which a shard's rows are to be sorted, within the shard alone. Columns of those two
    names in ``docs`` are replaced.
    """
    columns = [c for c in docs.columns if c not in ("mix_shard", "mix_order")]
    cut = Cut(spark, "mixing")
    rows = cut(_keyed(docs.select("doc_id", "text", "source"), seed).withColumn("size", n_words()).drop("text"))
    plan = _plan(spark, rows, cut, shards, seed)
    whole = docs.select(F.struct(*columns).alias("_row"), "doc_id", "text", "source")
    out = _applied(_keyed(whole, seed), plan).select("_row", F.col("_o.h").alias("_h"), F.posexplode("mix_shards").alias("_n", "mix_shard"))
    return out.select("_row.*", "mix_shard", _salt(seed, 4, F.col("_h"), F.col("_n")).alias("mix_order"))
