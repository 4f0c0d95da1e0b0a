"""Sharding through fixed virtual slots.

Records are hashed into a fixed number of slots. A slot map, a small versioned table, says which shard holds a
slot. Adding a shard, or moving bytes between shards, edits the map and moves whole slots; records never
change their slot.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import fresh
from .common import Cut, exists

SLOTS = 8192
#: Parts that the rows of a virtual slot are dealt into by their CRC.
PARTS = 32
#: Equal rows that one row stands for until the end.
RUN = 100_000


@dataclass(frozen=True)
class SlotMap:
    """Version and shard of each slot. Editing returns a map of the next version."""

    shards: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=(), compare=False)

    @property
    def n_shards(self) -> int:
        return max(self.shards) + 1

    @classmethod
    def of(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        """The map for a number of shards; it depends on nothing else. Grown from one shard, a shard at a time."""
        if not 1 <= n_shards <= slots:
            raise ValueError(f"between 1 and {slots} shards")
        out = cls((0,) * slots)
        for _ in range(n_shards - 1):
            out = out.grow()
        return out

    def grow(self) -> SlotMap:
        """One more shard: it takes an even share of slots, each from the shard that has most; no other slot moves."""
        held: list[list[int]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(self.shards):
            held[shard].append(slot)
        new, out, moved = len(held), list(self.shards), []
        for _ in range(len(out) // (new + 1)):
            giver = max(range(new), key=lambda s: (len(held[s]), -s))
            slot = held[giver].pop()
            out[slot] = new
            moved.append(slot)
        return SlotMap(tuple(out), self.version + 1, tuple(moved))

    def rebalance(self, slot_bytes: dict[int, int], tolerance: float = 0.05) -> SlotMap:
        """Moves slots from the fullest to the emptiest shard until all are within ``tolerance`` of the mean, or no move helps.

        slot_bytes: of at most ``len(self.shards)`` slots; absent slots are empty.
        """
        load, held = [0] * self.n_shards, [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(self.shards):
            load[shard] += slot_bytes.get(slot, 0)
            held[shard].append(slot)
        mean, out, moved = sum(load) / len(load), list(self.shards), []
        for _ in range(len(out)):
            high, low = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
            if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
                break
            gap = load[high] - load[low]
            fits = [s for s in held[high] if 0 < slot_bytes.get(s, 0) < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
            held[high].remove(slot)
            held[low].append(slot)
            load[high] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
            out[slot] = low
            moved.append(slot)
        return SlotMap(tuple(out), self.version + 1, tuple(moved))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the map table at ``path``; a version that is there already is refused."""
        at = f"{path}/version={self.version}"
        spark.range(len(self.shards)).select(F.col("id").cast("int").alias("slot"), self.shard_of(F.col("id")).alias("shard")).coalesce(1).write.mode("error").parquet(at)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """One version from the map table at ``path``, the latest by default. A map has as many rows as slots."""
        df = spark.read.parquet(path)
        version = df.agg(F.max("version")).head()[0] if version is None else version
        rows = df.where(F.col("version") == version).select("slot", "shard").collect()
        return cls(tuple(shard for _, shard in sorted(map(tuple, rows))), version)

    @classmethod
    def stored(cls, spark: SparkSession, path: str, n_shards: int, slots: int = SLOTS) -> SlotMap:
        """The map for a number of shards as the table at ``path`` has it, stored there first if it is new."""
        made = cls.of(n_shards, slots)
        if not exists(spark, f"{path}/version={made.version}"):
            made.save(spark, path)
        return cls.load(spark, path, made.version)

    def shard_of(self, slot: F.Column) -> F.Column:
        """A constant array, as long as there are slots, indexed by the slot."""
        return F.element_at(F.split(F.lit(",".join(map(str, self.shards))), ","), (slot + 1).cast("int")).cast("int")


def slot_of(key: F.Column, slots: int = SLOTS) -> F.Column:
    """The slot of a record; a null key has a slot like any other."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null"))), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, key: str = "doc_id", size: str = "size", slots: int = SLOTS) -> DataFrame:
    """Rows and bytes per slot: at most ``slots`` rows, summed before the shuffle."""
    return docs.groupBy(slot_of(F.col(key), slots).alias("vslot")).agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))


def shard_documents(docs: DataFrame, n_shards: int, path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """All of ``documents`` with their virtual slot, shard and place in it, and where growing or rebalancing would put them.

    Columns: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, slot_bytes, map_version,
    balanced_shard, balanced_version``. The law is ``key``: doc_id and the number of shards decide. ``size`` is the
    text's UTF-8 bytes (null: none) plus 16. ``slot`` numbers the rows of a shard from 0 without gaps, by virtual
    slot, CRC and doc_id. ``grown_shard`` is the shard with one shard more. Repeated rows get places of their own,
    rows with a null doc_id share a virtual slot, an empty table gives no rows. Columns other than doc_id and text
    are not looked at.

    The slot map is read from the table of versions ``by-key`` in the folder ``path`` (a new one if none is given),
    where it is stored first if there is none for so many shards. ``slot_bytes`` are summed by virtual slot; from
    them the map is rebalanced and stored as the next version of the table ``by-bytes``; its shards are
    ``balanced_shard``, which a mover of whole slots would follow.

    Equal rows are counted before the shuffle, by virtual slot and a part of the CRC, and become rows again at the end,
    so no key is gathered. The counts that place a slot in its shard are at most PARTS per slot, whatever the
    number of documents, and so may be broadcast; the driver sees one number for each slot.
    """
    spark = docs.sparkSession
    path = path or fresh(spark, "slot-map")
    now = SlotMap.stored(spark, f"{path}/by-key", n_shards, slots)
    cut = Cut(spark, "sharding")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("vslot"),
    ).withColumn("part", (F.col("text_crc32") % PARTS).cast("int"))
    counts = cut(rows.groupBy("vslot", "part").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes")))
    load = {r.vslot: r.n for r in counts.groupBy("vslot").agg(F.sum("n_bytes").alias("n")).collect()}  # at most as many as slots
    grown, balanced = now.grow(), now.rebalance(load)
    by_bytes = f"{path}/by-bytes"
    if exists(spark, by_bytes):
        balanced = replace(balanced, version=max(now.version, SlotMap.load(spark, by_bytes).version) + 1)
    balanced.save(spark, by_bytes)
    placed = counts.withColumn("shard", now.shard_of(F.col("vslot")))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("vslot", "part", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"), F.sum("n_bytes").over(Window.partitionBy("shard", "vslot")).alias("slot_bytes"))
    keys = ["vslot", "part", "text_crc32", "doc_id", "size"]
    own = Window.partitionBy("vslot", "part").orderBy("text_crc32", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("place", F.coalesce(F.sum("n").over(own), F.lit(0)))
    each = each.select(*keys, F.explode(F.expr(f"transform(sequence(0L, (n - 1) div {RUN}), i -> struct(place + i * {RUN} AS from, least(n - i * {RUN}, {RUN}L) AS n))")).alias("run"))
    each = each.select(*keys, F.explode(F.expr("sequence(run.from, run.from + run.n - 1)")).alias("place"))
    return each.join(F.broadcast(placed), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), grown.shard_of(F.col("vslot")).alias("grown_shard"),
        "vslot", "slot_bytes", F.lit(now.version).alias("map_version"), balanced.shard_of(F.col("vslot")).alias("balanced_shard"), F.lit(balanced.version).alias("balanced_version"),
    )
