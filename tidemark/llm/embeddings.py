"""Near-duplicate vectors by lattice hashing: projections decoded to E8 in several tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, components

COSINE = 0.93
TABLES = 3
#: Neighbouring cells that a vector visits besides its own, in each table.
PROBES = 4
#: Width of a cell, in the units of a projection of unit vectors; smaller cells hold fewer vectors and miss more pairs.
WIDTH = 1.5
SEED = 8
#: Members of a cell that meet in one task; larger cells are dealt into blocks, and each two blocks meet in a task.
CELL = 1024
ROWS = 16_384


@lru_cache(maxsize=1)
def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    ones = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*ones, *halves], float)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the nearer of the nearest points of D8 and of D8 shifted by a half in each coordinate."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(1) % 2)  # sums must be even: round the worst coordinate the other way
        worst = np.abs(off[odd]).argmax(1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def _projections(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).normal(size=(TABLES, size, 8)) / WIDTH


def cells(unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys [vector, table, cell] of the cells that unit vectors visit, their own first. salt: a number for each vector's label."""
    out = np.empty((len(unit), TABLES, PROBES + 1), np.int64)
    mix = np.random.default_rng(SEED).integers(1, 2**62, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for t, p in enumerate(_projections(unit.shape[1])):
        y = unit @ p
        home = decode(y)
        far = -2 * (y - home) @ _neighbours().T  # squared distance to a neighbour, but for what all have in common
        by = np.argpartition(far, PROBES, axis=1)[:, :PROBES]
        points = np.concatenate([home[:, None], home[:, None] + _neighbours()[by]], 1)
        with np.errstate(over="ignore"):
            h = ((2 * points).astype(np.int64).view(np.uint64) * mix).sum(2, dtype=np.uint64) + (salt.view(np.uint64)[:, None] + np.uint64(t + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        out[:, t] = h.view(np.int64)
    return out


def _unit(raw: list[bytes], size: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(vectors: DataFrame) -> DataFrame:
    """``vec_id, rid, label, vec``: rid names label and components, vec holds them as they came, floats or doubles; both null where a vector links with nothing."""
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, vecs = [], []
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ok = label is not None and x and None not in x
                v = np.array(x, kind) + np.zeros(1, kind) if ok else None  # no negative zeros
                ok = ok and np.isfinite(v).all() and v.any()
                vecs.append(v.tobytes() if ok else None)
                rids.append(hashlib.md5(label.encode() + b"\0" + vecs[-1], usedforsecurity=False).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rids, pa.binary()), batch.column(1), pa.array(vecs, pa.binary())], ["vec_id", "rid", "label", "vec"])

    name = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, f"vec_id {name}, rid binary, label string, vec binary")


def _kind(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def _salt(labels: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.md5(x.encode(), usedforsecurity=False).digest()[:8], "little", signed=True) for x in labels], np.int64)


def _keyed(unique: DataFrame, kind: str) -> DataFrame:
    """``unique`` with ``keys``: of each table the cell that a vector is at home in, then those that it visits.

    They are computed once and go with the vector from here on, so that all tasks agree on them.
    """
    bytes_each = int(kind[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vecs = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("label", "vec"))
            keys = np.empty((len(batch), TABLES * (PROBES + 1)), np.int64)
            for size in {len(x) for x in vecs}:
                own = [i for i, x in enumerate(vecs) if len(x) == size]
                for at in range(0, len(own), 2000):
                    part = own[at : at + 2000]
                    found = cells(_unit([vecs[i] for i in part], size // bytes_each, kind), _salt([f"{size}/{labels[i]}" for i in part]))
                    keys[part] = found.reshape(len(part), -1)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * keys.shape[1])
            yield batch.append_column("keys", pa.ListArray.from_arrays(ends, pa.array(keys.ravel())))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in unique.schema)
    return unique.mapInArrow(run, f"{kinds}, keys array<long>")


def _meet(own: list[tuple], cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Links and smallest link among members of one group ``(g, rid, label, vec, m, table, home, key, block, keys)``, of pairs that belong to it."""
    n = len(own)
    size = len(own[0][3])
    same_size = np.array([len(r[3]) == size for r in own])
    count, root = np.zeros(n, np.int64), np.arange(n)
    if not same_size.all():  # two cells of one hash: nothing to compare between them
        for s in {len(r[3]) for r in own}:
            at = [i for i in range(n) if len(own[i][3]) == s]
            c, r = _meet([own[i] for i in at], cosine, kind)
            count[at], root[at] = c, np.array(at)[r]
        return count, root
    unit = _unit([r[3] for r in own], size // int(kind[2:]), kind)
    home, block = np.array([r[6] for r in own]), np.array([r[8] for r in own])
    number = np.unique(np.array([r[2] for r in own], object), return_inverse=True)[1]
    m = np.array([r[4] for r in own])
    pairs = []
    for at in range(0, n, 512):
        cos = unit[at : at + 512] @ unit.T
        a, b = np.nonzero(cos >= cosine)
        a += at
        ok = (a < b) & (home[a] | home[b]) & (number[a] == number[b])
        if block.min() != block.max():
            ok &= block[a] != block[b]
        pairs.append((a[ok], b[ok]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if len(a):
        # a pair may meet in several cells; it belongs to the first, by table, where the later of the two is at home before the earlier
        keys = np.array([r[9] for r in own], np.int64).reshape(n, TABLES, PROBES + 1)
        rid = [r[1] for r in own]
        swap = np.array([rid[i] > rid[j] for i, j in zip(a, b, strict=True)])
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        mine = np.zeros(len(a), bool)
        open_ = np.ones(len(a), bool)
        table, key = own[0][5], own[0][7]
        ka, kb = keys[a], keys[b]
        for t in range(TABLES):
            for x, y in ((ka, kb), (kb, ka)):
                hit = open_ & (x[:, t] == y[:, t, :1]).any(1)  # x visits the home of y
                mine |= hit & (t == table) & (y[:, t, 0] == key)
                open_ &= ~hit
        a, b = a[mine], b[mine]
        np.add.at(count, a, m[b])
        np.add.at(count, b, m[a])
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
    return count, root


def _matched(rows: DataFrame, cosine: float, kind: str) -> DataFrame:
    """``rid, n, root`` for vectors with links, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(own: list[tuple]) -> pa.RecordBatch:
            rid, n, root, at = [], [], [], 0
            while at < len(own):
                to = at
                while to < len(own) and own[to][0] == own[at][0]:
                    to += 1
                group = own[at:to]
                count, first = _meet(group, cosine, kind) if len(group) > 1 else (np.zeros(1), [0])
                for i in np.flatnonzero(count):
                    rid.append(group[i][1])
                    n.append(int(count[i]))
                    root.append(group[first[i]][1])
                at = to
            return pa.RecordBatch.from_arrays([pa.array(rid, pa.binary()), pa.array(n, pa.int64()), pa.array(root, pa.binary())], ["rid", "n", "root"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= ROWS:
                keep = len(held) - 1
                while keep and held[keep - 1][0] == held[-1][0]:
                    keep -= 1
                if keep:
                    yield done(held[:keep])
                    held = held[keep:]
        if held:
            yield done(held)

    return rows.select("g", "rid", "label", "vec", "m", "table", "home", "key", "block", "keys").mapInArrow(run, "rid binary, n long, root binary")


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, label, embedding)``.

    Two vectors link if their labels are equal and their cosine, in double precision, is at least ``cosine``.
    Vectors with a null label, null or zero vectors, and those with null or non-finite components link with
    nothing; vectors of different length neither. n_links counts other rows linked directly, component_id is the
    smallest vec_id reachable, itself included, and kept says that it is the row's own. Repeated rows link with
    one another; a null vec_id is a component's id only if all members have none, and such rows are kept. An
    empty table gives no rows; other columns are ignored.

    Equal vectors of a label become one with a multiplicity. The rest are found if they meet: each vector has a
    home cell in each of TABLES lattices and visits the PROBES nearest of its neighbours, and those who visit a
    cell meet those at home in it. Cosines are matrix products within a cell; a pair is counted in the first cell
    where it meets, so only counts and a spanning forest leave the task, never pairs. Cells with many vectors are
    dealt into blocks that meet two by two.
    """
    cut = Cut(spark, "embeddings")
    rows = cut(packed(vectors))
    unique = rows.where("rid IS NOT NULL").groupBy("rid").agg(F.count("*").alias("m"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("least"))
    unique = cut(_keyed(unique, _kind(vectors)))
    visits = unique.select("rid", F.posexplode("keys").alias("i", "key"))
    visits = visits.select("rid", "key", F.floor(F.col("i") / (PROBES + 1)).cast("byte").alias("table"), (F.col("i") % (PROBES + 1) == 0).alias("home"))
    sizes = visits.groupBy("key", "table").agg(F.count("*").alias("k"), F.sum(F.col("home").cast("int")).alias("homes")).where("homes > 0 AND k > 1").select("key", "table", "k")
    sizes = cut(sizes)
    met = visits.join(sizes, ["key", "table"]).withColumn("blocks", F.ceil(F.col("k") / CELL).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.withColumn("g", F.xxhash64("key", "table", F.least("block", "with"), F.greatest("block", "with"))).select("rid", "key", "table", "home", "block", "g")
    met = met.join(unique.select("rid", "label", "vec", "m", "keys"), "rid").repartition("g").sortWithinPartitions("g", "table", "key")
    found = cut(_matched(met, cosine, _kind(vectors)))
    links = found.groupBy("rid").agg(F.sum("n").alias("n"))
    roots = components(spark, found.select(F.col("rid").alias("a"), F.col("root").alias("b")), cut)
    of = unique.select("rid", "m", "least").join(links, "rid", "left").join(roots, F.col("rid") == F.col("node"), "left")
    of = cut(of.select("rid", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root")))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(of.join(least, "root").select(F.col("rid").alias("r"), "n_links", "component_id"))
    out = rows.join(of, F.col("rid") == F.col("r"), "left")
    component = F.when(F.col("r").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
