"""Near-duplicates by SimHash, found with a generalised pigeonhole over correlated bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, components, slices, small

BITS = 64
SHINGLE = 3
RADIUS = 2
#: Numbers of parts that are weighed against each other: fewer parts have longer keys, but are probed around their values.
PARTS = (3, 2)
#: Bits of a part that the histograms for estimates look at: parts * 2**PREFIX counts, whatever the input.
PREFIX = 14
#: What a probe costs, in candidates.
PROBE_COST = 2.0
#: Pairs that one key may give; keys with more are divided by parts of their other bits, until LEAF or fewer fingerprints share a key.
KEY_PAIRS, LEAF = 4096, 1024
SEED = 42
#: Names that this module gives to columns of its callers' tables.
HIDDEN = ("_sh_fp", "_sh_id", "_sh_node", "_sh_n", "_sh_marks")
#: Nodes that share a shingle and are compared pair by pair; those who share one with more are compared in blocks: of so many by whole sets, of CROWD by their marks.
SHARED, BLOCK, CROWD = 48, 256, 2048
#: Nodes that a task remembers having listed; those beyond are listed again, which changes nothing.
LISTED = 1 << 18
#: Bits by which ``monotonically_increasing_id`` numbers the rows of a partition.
ROW_BITS = 33
#: Rows of one bitmap of rows that are chosen, and what all bitmaps may have in bytes to be sent to every executor.
BITMAP_ROWS, BITMAPS_BYTES = 1 << 15, 32 << 20
#: Where no contract says otherwise, near-duplicates have a Jaccard similarity of 4/5 or more by five-word shingles.
SHINGLE_SIMILAR, SIMILAR = 5, (4, 5)
#: Bits that fingerprints of such texts may differ in: 10 are expected at the least similarity, and this is five standard deviations more.
FAR = 24
#: Shingles are counted by so many bits of their hashes, over all texts, to order them from rare to common.
SKETCH = 17
#: Marks of a text are two to four bits for each different shingle, and no more than 2**MARKS; of pairs, so many words are held at a time.
MARKS, MARK_WORDS = 14, 1 << 19


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a whole text's word shingles, repeats included; a shorter text is one shingle, a text without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and the six white-space bytes part words
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text's word shingles, repeats included."""
    return _signed(hashes(text, shingle))


def _signed(h: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; a text without words (null too) has the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(unique: DataFrame) -> np.ndarray:
    """Absolute correlation of each two bits over all fingerprints; 64 * 64 sums, added up before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            x = np.ones((len(batch), BITS + 1), np.float32)
            x[:, :BITS] = _bits(batch.column(0).to_numpy())
            both += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.size, dtype=np.int32)), pa.array(both.ravel())], ["cell", "n"])

    sums = np.zeros((BITS + 1) ** 2)
    for cell, n in unique.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n")).collect():  # 65 * 65 rows
        sums[cell] = n
    both = sums.reshape(BITS + 1, BITS + 1)
    mean = both[:BITS, BITS] / max(both[BITS, BITS], 1)
    cov = both[:BITS, :BITS] / max(both[BITS, BITS], 1) - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    return np.abs(cov / np.outer(sd, sd))


def choose_parts(n: int) -> int:
    """The number of parts whose probes and candidates cost least for n fingerprints, were all bits even; what each part then gets is up to ``allocate``."""

    def cost(parts: int) -> float:
        width, spare = BITS / parts, RADIUS - parts + 1
        probes = sum(comb(int(width), k) for k in range(spare + 1)) + parts - 1
        return probes * (PROBE_COST + n / 2**width)

    return min(PARTS, key=cost)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of equal size (within one): a group starts with the bit most correlated with those left, and takes the ones most correlated with itself."""
    left, out = list(range(len(corr))), []
    for k in range(parts):
        width = (len(corr) * (k + 1)) // parts - (len(corr) * k) // parts
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(own)
    return out


def project(fps: np.ndarray, own: list[int]) -> np.ndarray:
    """The values of some bits, the first of them highest."""
    u, out = fps.view(np.uint64), np.zeros(len(fps), np.int64)
    for b in own:
        out = (out << 1) | ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
    return out


def balls(hist: np.ndarray, width: int) -> np.ndarray:
    """Estimated candidates within each radius up to RADIUS, by prefix; bits beyond the prefix count as even."""
    p = hist.size.bit_length() - 1
    v = np.arange(hist.size)
    near = lambda h: sum(h[v ^ (1 << b)] for b in range(p))
    rings = [hist.astype(float)]
    rings.append(near(rings[0]))
    rings.append((near(rings[1]) - p * rings[0]) / 2)
    rest = width - p
    within = lambda e: sum(comb(rest, k) for k in range(e + 1)) / 2**rest
    return np.stack([sum(rings[j] * within(e - j) for j in range(e + 1)) for e in range(RADIUS + 1)]).astype(np.float32)


def allocate(costs: list[np.ndarray], radius: int = RADIUS) -> np.ndarray:
    """Thresholds of each part and row, -1 (not probed) to radius, that add up to radius - parts + 1 at least cost.

    costs: of each part, an array [threshold, row] from threshold 0. Two fingerprints within the radius differ by
    no more than its threshold in some part, else their differences would add up to more than the radius. Dynamic
    programming over parts and the sum so far.
    """
    parts, rows = len(costs), costs[0].shape[1]
    goal = radius - parts + 1
    # a sum lies between -parts and radius * parts
    f = {0: np.zeros(rows)}
    took: list[dict[int, np.ndarray]] = []
    for c in costs:
        g: dict[int, np.ndarray] = {}
        t: dict[int, np.ndarray] = {}
        for done, cost in f.items():
            for e in range(-1, radius + 1):
                new = cost if e < 0 else cost + c[e]
                at = done + e
                if at not in g:
                    g[at], t[at] = new.copy(), np.full(rows, e, np.int8)
                else:
                    better = new < g[at]
                    g[at][better], t[at][better] = new[better], e
        f = g
        took.append(t)
    out = np.zeros((parts, rows), np.int8)
    at = np.full(rows, goal)
    for i in range(parts - 1, -1, -1):
        for s in np.unique(at):
            out[i, at == s] = took[i][s][at == s]
        at = at - out[i]
    return out


def keys(unique: DataFrame, groups: list[list[int]], tables) -> DataFrame:
    """``part, value, fp, probe``: each fingerprint's own value in each part, and the values that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {}
        for i, own in enumerate(groups):
            one = [1 << b for b in range(len(own))]
            masks[i] = [np.array([0]), np.array([0, *one]), np.array([0, *one, *(a | b for n, a in enumerate(one) for b in one[:n])])]
        for batch in batches:
            for start in range(0, len(batch), 5000):
                fps = batch.column(0).slice(start, 5000).to_numpy(zero_copy_only=False)
                values = [project(fps, own) for own in groups]
                costs = [tables.value[i][:, values[i] >> max(0, len(own) - PREFIX)] + PROBE_COST * np.array([[len(m)] for m in masks[i]]) for i, own in enumerate(groups)]
                found = [(np.full(len(fps), i, np.int8), values[i], fps, np.zeros(len(fps), bool)) for i in range(len(groups))]
                for i, e in enumerate(allocate(costs)):
                    for r in range(RADIUS + 1):
                        v = values[i][e == r]
                        probes = (v[:, None] ^ masks[i][r]).ravel()
                        found.append((np.full(len(probes), i, np.int8), probes, np.repeat(fps[e == r], len(masks[i][r])), np.ones(len(probes), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["part", "value", "fp", "probe"])

    return unique.select("fp").mapInArrow(run, "part byte, value long, fp long, probe boolean")


def _signed_mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _narrowed(hot: DataFrame, corr: np.ndarray, left: list[list[int]]) -> tuple[DataFrame, list[list[int]]]:
    """``hot(key, kind, fp)`` with longer keys: a key's fingerprints agree in all bits but left[kind], which are parted anew.

    Two that differ in RADIUS bits at most agree in one of RADIUS + 1 parts of these, so each fingerprint gets so many
    keys. Also the bits that are still left, by the new kinds.
    """
    rest, rows = [], []
    for own in left:
        groups = group_bits(corr[np.ix_(own, own)], RADIUS + 1)
        parts = []
        for g in groups:
            bits = [own[i] for i in g]
            parts.append(F.struct(F.lit(_signed_mask(bits)).cast("long").alias("mask"), F.lit(len(rest)).alias("kind")))
            rest.append([b for b in own if b not in set(bits)])
        rows.append(F.array(*parts))
    each = hot.select("key", "fp", F.explode(F.element_at(F.array(*rows), F.col("kind") + 1)).alias("p"))
    return each.select(F.xxhash64("key", "p.kind", F.col("fp").bitwiseAND(F.col("p.mask"))).alias("key"), F.col("p.kind").alias("kind"), "fp"), rest


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each one reaches, once the links a, b are there too."""
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _verified(rows: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the links within each key of ``rows(key, fp)``, which LEAF fingerprints share at most, or those that agree in almost all bits."""

    def linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = np.arange(len(fps))
        u = fps.view(np.uint64)
        for at in range(0, len(u), 256):
            a, b = np.nonzero(np.bitwise_count(u[at : at + 256, None] ^ u[None, :]) <= RADIUS)
            root = _joined(root, a + at, b)
        at = np.flatnonzero(root != np.arange(len(fps)))
        return fps[root[at]], fps[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if not held.shape[1]:
                continue
            edge = np.flatnonzero(np.diff(held[0])) + 1
            end = held.shape[1] if batch is None else edge[-1] if len(edge) else 0
            found = [linked(g) for g in np.split(held[1, :end], edge[edge < end]) if len(g) > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
            held = held[:, end:]

    return rows.select("key", "fp").distinct().repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def links(spark: SparkSession, unique: DataFrame, cut: Cut) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints within RADIUS of each other; each row of ``unique(fp)`` is distinct.

    A key is a part and a value; those who probe it meet those who have it, and a pair is kept if it is within
    the radius. The fingerprints of a key with more than KEY_PAIRS such pairs agree in the part, so the pigeonhole
    is applied to their other bits: they get longer keys, of the part and of a part of the rest, again and again, until
    LEAF or fewer share a key or a few bits are left. Those are compared in their task, which passes on a spanning
    forest and not their pairs. So a dense group costs each of its fingerprints 3 keys a round, of which there are 4 at most.
    """
    corr = correlations(unique)
    parts = choose_parts(unique.count())
    groups = group_bits(corr, parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((parts, 1 << PREFIX), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i, own in enumerate(groups):
                hist[i] += np.bincount(project(fps, own) >> (len(own) - PREFIX), minlength=1 << PREFIX)
        at = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(hist.ravel()[at])], ["cell", "n"])

    hist = np.zeros(parts << PREFIX, np.int64)
    counted = unique.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for cell, n in counted.collect():  # at most parts * 2**PREFIX rows
        hist[cell] = n
    tables = spark.sparkContext.broadcast([balls(h, len(own)) for h, own in zip(hist.reshape(parts, -1), groups, strict=True)])
    rows = cut(keys(unique, groups, tables))
    tables.destroy()
    probes = F.sum(F.col("probe").cast("long"))
    pairs = (F.count("*") - probes) * probes
    busy = rows.groupBy("part", "value").agg(pairs.alias("pairs")).where("pairs > 1")
    busy = cut(busy)
    calm = rows.join(busy.where(f"pairs <= {KEY_PAIRS}").select("part", "value"), ["part", "value"])
    x, y = calm.where("NOT probe").alias("x"), calm.where("probe").alias("y")
    near = (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS) & (F.col("x.fp") != F.col("y.fp"))
    found = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    left = [[b for b in range(BITS) if b not in set(own)] for own in groups]
    hot = rows.join(busy.where(f"pairs > {KEY_PAIRS}").select("part", "value"), ["part", "value"])
    # those who probe from a distance do not agree in the part's bits: what they agree in is the key, and all other bits are parted
    hot = cut(hot.select(F.xxhash64("part", "value").alias("key"), F.col("part").cast("int").alias("kind"), "fp").distinct())
    while hot.limit(1).count():
        longer, left = _narrowed(hot, corr, left)
        longer = cut(longer)
        last = min(map(len, left)) <= RADIUS + 1 or max(map(len, left)) <= 10
        sizes = cut(longer.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"))
        small_keys = sizes if last else sizes.where(F.col("k") <= LEAF)
        found = found.unionByName(cut(_verified(longer.join(small_keys.select("key"), "key"))))
        if last:
            break
        hot = cut(longer.join(sizes.where(F.col("k") > LEAF).select("key"), "key"))
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: its SimHash, and the smallest doc_id reachable by links.

    Fingerprints link at RADIUS or fewer differing bits. Texts without words have the fingerprint 0 and link like
    others. Equal fingerprints are one node from the start, so exact copies cost one row each. Repeated rows give
    a row each; a null doc_id is never a component's id unless all of its members have none; an empty table gives
    no rows; other columns are ignored. Fingerprints, not texts, are shuffled.
    """
    cut = Cut(spark, "simhash")
    rows = cut(fingerprints(docs, shingle))
    unique = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(spark, links(spark, unique, cut), cut)
    unique = unique.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = unique.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(unique.join(least, "root").select("fp", "component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that of the smallest doc_id (nulls last).

    If several rows of a component share that doc_id, any one of them stays. Columns whose names begin with _sh_ are dropped.
    """
    cut = Cut(spark, "simhash")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in HIDDEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.append_column("_sh_fp", pa.array([fingerprint(t.as_py(), shingle) for t in text], pa.int64()))

    docs = docs.drop(*HIDDEN)
    rows = cut(docs.mapInArrow(run, f"{kinds}, _sh_fp long").withColumn("_sh_id", F.monotonically_increasing_id()))
    unique = cut(rows.groupBy(F.col("_sh_fp").alias("fp")).agg(_least_row()))
    roots = components(spark, links(spark, unique, cut), cut)
    unique = unique.join(roots, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    return _rows_that_stay(rows, unique, cut).select(*docs.columns)


def _least_row() -> F.Column:
    """Of a group of rows, the one of the smallest doc_id (nulls last), by the row's own number."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_sh_id").alias("row"))).alias("least")


def _rows_that_stay(rows: DataFrame, unique: DataFrame, cut: Cut) -> DataFrame:
    """Of the rows of each root of ``unique(root, least)`` the least; texts are moved only if the table is too large for ``_chosen``'s bitmaps."""
    stays = cut(unique.groupBy("root").agg(F.min("least").alias("s")).select(F.col("s.row").alias("_sh_id")))
    return _chosen(rows, stays)


def _chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose _sh_id is among the stored ``ids(_sh_id)``. Texts stay where they are: executors are sent a bit for each row, up to BITMAPS_BYTES."""
    part, row = F.shiftright("_sh_id", ROW_BITS), F.col("_sh_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    span, parts = rows.agg(F.max(row) + 1, F.max(part) + 1).head()
    if not span or span * parts > 8 * BITMAPS_BYTES:
        return rows.join(small(ids), "_sh_id", "left_semi")
    place = part * F.lit(span) + row
    at = F.shiftright(place, BITMAP_ROWS.bit_length() - 1)
    bit = place.bitwiseAND(F.lit(BITMAP_ROWS - 1))
    bitmaps = ids.select(at.alias("_sh_at"), bit.alias("bit")).groupBy("_sh_at").agg(F.bitmap_construct_agg("bit").alias("_sh_bits"))
    byte = F.conv(F.hex(F.substring("_sh_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    chosen = F.expr("shiftright(_sh_byte, cast(_sh_bit & 7 AS int)) & 1") == 1
    out = rows.withColumn("_sh_at", at).join(F.broadcast(bitmaps), "_sh_at").withColumns({"_sh_byte": byte, "_sh_bit": bit})
    return out.where(chosen).select(*rows.columns)


def rarest(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Of n distinct hashes, so many of the rarest that two sets of at least SIMILAR similarity list one in common.

    Any fixed order of hashes is right; counts by the hashes' highest bits put common shingles last. Also how many of
    the list the smaller set of a pair needs, if the larger one has its whole list.
    """
    top, of = SIMILAR
    own = h[np.lexsort((h, counts[h >> np.uint64(BITS - SKETCH)]))]
    return own[: len(h) + len(h) * -top // of + 1], len(h) + len(h) * -2 * top // (top + of) + 1


def marks(h: np.ndarray) -> bytes:
    """Of each value of the lowest bits, whether an odd number of the distinct hashes has it: two sets differ in at least as many hashes as their marks do in bits."""
    m = 1 << min(max((2 * len(h) - 1).bit_length(), 6), MARKS)
    return np.packbits(np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_similar(n: np.ndarray, fps: np.ndarray, own: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of places a, b can be similar, by sizes n, fingerprints and marks; no pair of SIMILAR similarity and within FAR is refused."""
    top, of = SIMILAR
    ok = (n[a] * of >= n[b] * top) & (n[b] * of >= n[a] * top) & (np.bitwise_count(fps.view(np.uint64)[a] ^ fps.view(np.uint64)[b]) <= FAR)
    words = np.array([len(x) // 8 for x in own], np.int64)
    least = np.minimum(words[a], words[b])
    for m in np.unique(least[ok]):
        who = np.flatnonzero(ok & (least == m))
        used = np.unique(np.concatenate([a[who], b[who]]))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(own[i], np.uint64).reshape(-1, m)) for i in used])  # longer marks, as if they were of m words
        step = max(1, MARK_WORDS // int(m))
        for at in range(0, len(who), step):
            w = who[at : at + step]
            apart = np.bitwise_count(folded[np.searchsorted(used, a[w])] ^ folded[np.searchsorted(used, b[w])]).sum(1, dtype=np.int64)
            ok[w] = apart * (top + of) <= (n[a[w]] + n[b[w]]) * (of - top)
    return ok


def _close_in_blocks(rows: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the pairs that may be similar within each group of ``rows(g, block, node, n, root, fp, marks)``; pairs are left out as in ``_similar_in_blocks``."""

    def linked(block, node, n, root, fps, own) -> tuple[np.ndarray, np.ndarray]:
        k, two = len(node), block.min() != block.max()
        found, step = np.arange(k), max(1, (1 << 20) // k)
        for at in range(0, k, step):
            i = np.arange(at, min(at + step, k))
            near = (root[i, None] != root[None, :]) & (i[:, None] < np.arange(k)[None, :])
            if two:
                near &= block[i, None] != block[None, :]
            a, b = np.nonzero(near)
            a += at
            ok = may_be_similar(n, fps, own, a, b)
            found = _joined(found, a[ok], b[ok])
        at = np.flatnonzero(found != np.arange(k))
        return node[found[at]], node[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            a, b = linked(*(np.array([r[i] for r in held], np.int64) for i in (1, 2, 3, 4, 5)), [r[6] for r in held])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    return rows.select("g", "block", "node", "n", "root", "fp", "marks").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def _met(members: DataFrame, size: int) -> DataFrame:
    """``members`` with ``g, block``: those of a crowd in blocks of about size, and a group for each block and each two blocks."""
    blocks = members.groupBy("crowd").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    members = members.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    g = F.xxhash64("crowd", F.least("block", "with"), F.greatest("block", "with"))
    return members.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("g", g)


def _shared_keys(keys: DataFrame) -> DataFrame:
    """``key, node, n, first, least`` of keys that several nodes list, each node once, and the least node of the key; rows are moved once and each task reads its own in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "n", "first", "least"]
        held, least_held, met = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, bool)], 0, False  # the last row, its key's least node, and whether a row before it has its key
        for batch in batches:
            if not len(batch):
                continue
            columns = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            key, node = columns[:2]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            columns = [c[new] for c in columns]
            key, node = columns[:2]
            again = np.zeros(len(key) + 1, bool)  # the row before has this one's key
            again[1:-1] = key[1:] == key[:-1]
            begins = ~again[:-1]
            least = node[begins][np.cumsum(begins) - 1]
            if len(held[0]):
                least[key == held[0][0]] = least_held
                again[0] = met
            out = again[:-1] | again[1:]
            out[-1] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (*columns, least)], names)
            held, least_held, met = [c[-1:] for c in columns], least[-1], bool(again[-2])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*held, np.array([least_held], np.int64))], names)

    return keys.select("key", "node", "n", "first").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, n int, first boolean, least long")


def _similar_in_blocks(rows: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the similar pairs within each group of ``rows(g, block, node, n, root, own)``.

    Left out are pairs that are connected (of one root), and, where a group has two blocks, those of one block. Overlaps
    are matrix products over the shingles that occur twice, a few thousand at a time.
    """
    top, of = SIMILAR

    def linked(block, node, n, root, own) -> tuple[np.ndarray, np.ndarray]:
        k, ends = len(node), np.cumsum([len(x) for x in own])
        _, at, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        place = np.cumsum(often > 1) - 1
        owner = np.searchsorted(ends, np.arange(len(at)), side="right")
        twice = often[at] > 1
        at, owner = place[at[twice]], owner[twice]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        common = np.zeros((k, k), np.float32)  # whole numbers below 2**24
        for begin in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):
            i, j = np.searchsorted(at, (begin, begin + 2048))
            x = np.zeros((k, 2048), np.float32)
            x[owner[i:j], at[i:j] - begin] = 1
            common += x @ x.T
        near = common.astype(np.int64) * (top + of) >= (n[:, None] + n[None, :]) * top
        near &= root[:, None] != root[None, :]
        if block.min() != block.max():
            near &= block[:, None] != block[None, :]
        found = _joined(np.arange(k), *np.nonzero(np.triu(near, 1)))
        at = np.flatnonzero(found != np.arange(k))
        return node[found[at]], node[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            block, node, n, root = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3, 4))
            a, b = linked(block, node, n, root, [r[5] for r in held])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for i, row in enumerate(zip(*columns, strict=True)):
                if held and held[-1][0] != row[0]:
                    yield done()
                    held = []
                held.append((*row, batch.column(5)[i].values.to_numpy()))
        if held:
            yield done()

    return rows.select("g", "block", "node", "n", "root", "own").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def similar_links(spark: SparkSession, rows: DataFrame, unique: DataFrame, cut: Cut) -> DataFrame:
    """Edges ``a, b`` between nodes that connect all whose sets of SHINGLE_SIMILAR-word shingles have a Jaccard similarity of SIMILAR or more.

    ``rows`` have ``_sh_node, _sh_id, text``, and ``unique`` has ``node, fp, id, n``: a node is a distinct set of n, id the
    row that stands for it. Candidates are SimHash links and those who list a rare shingle in common, which no pair
    escapes; those whose fingerprints are FAR apart are left, and so are those whose marks differ in more bits than similar
    sets do in shingles. Each other one is tested on its whole sets, so these are moved for few pairs that fail. First each
    is held against three of the least nodes of its shingles, and the least of its fingerprint; then against those who
    share a shingle and are not connected yet, so that near-copies are not expanded into pairs. ``unique`` also has ``marks``.
    """
    top, of = SIMILAR

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += np.bincount((np.unique(hashes(text.as_py(), SHINGLE_SIMILAR)) >> np.uint64(BITS - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["cell", "n"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in (p for batch in batches for p in slices(batch)):
            found = []
            for node, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if node not in done:
                    if len(done) >= LISTED:
                        done.clear()
                    done.add(node)
                    h = np.unique(hashes(text.as_py(), SHINGLE_SIMILAR))
                    if len(h):
                        rare, first = rarest(h, counts.value)
                        found.append((rare.view(np.int64), np.full(len(rare), node, np.int64), np.full(len(rare), len(h), np.int32), np.arange(len(rare)) < first))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["key", "node", "n", "first"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(hashes(t.as_py(), SHINGLE_SIMILAR)).view(np.int64) for t in part.column(1)], pa.list_(pa.int64()))], ["node", "own"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, b, n_a, n_b, fp_a, fp_b), k = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]), len(batch)
            ok = may_be_similar(np.concatenate([n_a, n_b]), np.concatenate([fp_a, fp_b]), batch.column(6).to_pylist() + batch.column(7).to_pylist(), np.arange(k), np.arange(k, 2 * k))
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, b, n_a, n_b)], ["a", "b", "n_a", "n_b"])

    def sized(pairs: DataFrame) -> DataFrame:
        size = lambda c: unique.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "fp")))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        return pairs.join(size("a"), "a").join(size("b"), "b").where((F.col("n_a") * of >= F.col("n_b") * top) & (F.col("n_b") * of >= F.col("n_a") * top) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= FAR))

    def tested(pairs: DataFrame) -> DataFrame:
        """Of different pairs ``a, b, n_a, n_b, fp_a, fp_b`` the similar ones; marks are moved for these pairs alone."""
        for c in "ab":
            pairs = pairs.join(unique.select(F.col("node").alias(c), F.col("marks").alias(f"marks_{c}")), c)
        pairs = cut(pairs.select("a", "b", "n_a", "n_b", "fp_a", "fp_b", "marks_a", "marks_b").mapInArrow(close, "a long, b long, n_a long, n_b long"))
        need = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(unique, "node").select(F.col("id").alias("_sh_id")))
        sets = cut(_chosen(rows, need).select("_sh_node", "text").mapInArrow(whole, "node long, own array<long>"))
        x, y = (sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
        common = F.size(F.array_intersect("own_a", "own_b"))
        out = cut(pairs.join(x, "a").join(y, "b").where(common * (top + of) >= (F.col("n_a") + F.col("n_b")) * top).select("a", "b"))
        cut.drop(pairs, need, sets)
        return out

    table = np.zeros(1 << SKETCH, np.int64)
    found = rows.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2**SKETCH rows
    table[found["cell"].to_numpy()] = found["n"].to_numpy()
    counts = spark.sparkContext.broadcast(table)
    shared = cut(_shared_keys(rows.select("_sh_node", "text").mapInArrow(listed, "key long, node long, n int, first boolean")))
    counts.destroy()

    fps = cut(unique.groupBy("fp").agg(F.min("node").alias("head")))
    near = links(spark, fps.select("fp"), cut)
    name = lambda c: fps.select(F.col("fp").alias(c), F.col("head").alias(f"n_{c}"))
    near = near.join(name("a"), "a").join(name("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    same = unique.join(fps, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    few = shared.groupBy("node").agg(F.array(F.min("least"), F.max("least"), F.min_by("least", "key")).alias("some"))
    first = tested(sized(near.unionByName(same).unionByName(few.select(F.explode(F.array_distinct("some")).alias("a"), F.col("node").alias("b")))))
    roots = components(spark, first, cut)
    rooted = cut(shared.join(roots, "node", "left").select("key", "node", "n", "first", F.coalesce("root", "node").alias("root")))
    cut.drop(shared)
    split = cut(rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key"))
    left = cut(rooted.join(split, "key", "left_semi").join(unique.select("node", "fp"), "node"))
    cut.drop(rooted)
    # few who share a shingle meet pair by pair
    often = cut(left.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("least")))
    calm = left.join(often.where(F.col("k") <= SHARED).select("key"), "key", "left_semi")
    x, y = calm.where("first").alias("x"), calm.alias("y")
    smaller = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & smaller & (F.col("x.n") * of >= F.col("y.n") * top)
    apart &= F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= FAR
    met = x.join(y, apart).selectExpr("x.node AS a", "y.node AS b", "bigint(x.n) AS n_a", "bigint(y.n) AS n_b", "x.fp AS fp_a", "y.fp AS fp_b")
    second = tested(met.distinct())
    # many, and those who share other shingles with them, meet in blocks: each pair once, whatever they share
    busy = cut(left.join(often.where(F.col("k") > SHARED).select("key", "least"), "key").select("node", "n", "root", "least").distinct())
    crowds = components(spark, busy.select(F.col("least").alias("a"), F.col("node").alias("b")), cut)
    members = cut(busy.select("node", "n", "root").distinct().join(crowds.withColumnRenamed("root", "crowd"), "node"))
    close_links = cut(_close_in_blocks(_met(members.join(unique.select("node", "fp", "marks"), "node"), CROWD)))
    # of a crowd those stay whose marks agree with another's, and with them they are smaller crowds
    members = cut(members.drop("crowd").join(components(spark, close_links, cut).withColumnRenamed("root", "crowd"), "node"))
    meet = _met(members, BLOCK).select("g", "block", "node", "n", "root")
    need = cut(members.select("node").join(unique, "node").select(F.col("id").alias("_sh_id")))
    sets = cut(_chosen(rows, need).select("_sh_node", "text").mapInArrow(whole, "node long, own array<long>"))
    third = cut(_similar_in_blocks(meet.join(sets, "node")))
    cut.drop(left, busy, need, sets)
    return first.unionByName(second).unionByName(third)


def keep_one_similar(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates by ``similar_links``: of each component one row stays, that of the smallest doc_id (nulls last).

    Texts without words are copies of each other. If several rows of a component share that doc_id, any one of them
    stays. Columns whose names begin with _sh_ are dropped.
    """
    from xxhash import xxh64_intdigest

    cut = Cut(spark, "similar")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in HIDDEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            each = []
            for t in batch.column(batch.schema.get_field_index("text")):
                h = hashes(t.as_py(), SHINGLE_SIMILAR)
                own = np.unique(h)
                each.append((_signed(h), xxh64_intdigest(own.tobytes(), SEED), len(own), marks(own)))
            nodes = np.array([x[1] for x in each], np.uint64).view(np.int64)
            batch = batch.append_column("_sh_fp", pa.array([x[0] for x in each], pa.int64())).append_column("_sh_node", pa.array(nodes))
            yield batch.append_column("_sh_n", pa.array([x[2] for x in each], pa.int64())).append_column("_sh_marks", pa.array([x[3] for x in each], pa.binary()))

    docs = docs.drop(*HIDDEN)
    rows = cut(docs.mapInArrow(run, f"{kinds}, _sh_fp long, _sh_node long, _sh_n long, _sh_marks binary").withColumn("_sh_id", F.monotonically_increasing_id()))
    unique = rows.groupBy(F.col("_sh_node").alias("node")).agg(_least_row(), F.min("_sh_fp").alias("fp"), F.min("_sh_n").alias("n"), F.min("_sh_marks").alias("marks"))
    unique = cut(unique.withColumn("id", F.col("least.row")))
    roots = components(spark, similar_links(spark, rows, unique, cut), cut)
    unique = unique.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    return _rows_that_stay(rows, unique, cut).select(*docs.columns)
