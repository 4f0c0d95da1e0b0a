"""Shared plumbing: table reading, cutting lineage in the shared folder, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir

#: Words are maximal runs without these six ASCII white-space characters.
WS = "\\x20\\x09-\\x0D"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a Python worker holds decoded at a time, a longer text alone.
TEXT_BYTES = 1 << 21
#: Bytes of rows that Spark sends to a Python worker at a time, unless its user has set that; else 10,000 rows of any size are one batch.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Edges that a task joins in memory at a time.
EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def bounded(spark: SparkSession) -> None:
    """From now on batches for Python are cut by their bytes too, so that neither an executor's buffers nor its workers follow the length of rows."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Cut:
    """Writes intermediate tables to the shared folder, so that neither a lost executor nor a second use recomputes them.

    Tables that are no longer needed are dropped with ``drop``; the rest go when the process ends, since a
    returned DataFrame still reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        p, fs = _path(spark, self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def __call__(self, df: DataFrame) -> DataFrame:
        """Each table is written by one execution of its own, at whose end Spark removes that execution's shuffle files."""
        self.n += 1
        path, conf = f"{self.root}/{self.n}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEANUP, before) if before else conf.unset(_CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            remove(self.spark, df._cut_path)


#: What a table may have at most to be sent to every executor.
SMALL_ROWS, SMALL_BYTES = 100_000, 8_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its rows and the bytes of its texts are counted and few; else as it is, to be joined by a shuffle."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).head()
    return F.broadcast(df) if n <= SMALL_ROWS and size <= SMALL_BYTES else df


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of about TEXT_BYTES of a text column, so that memory follows the longest text and not the batch."""
    sizes, at, size = batch.column(batch.schema.get_field_index(column)), 0, 0
    for i, n in enumerate(pa.compute.binary_length(sizes).to_pylist()):
        size += n or 0
        if size >= TEXT_BYTES:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < len(batch):
        yield batch.slice(at)


def _joined_stars(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` that connect the same nodes, v being the smallest that a block of a task's edges connects to u."""

    def stars(pairs: list[tuple]) -> pa.RecordBatch:
        up: dict = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= EDGES:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(edges.schema["u"].dataType), edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInArrow(run, f"u {name}, v {name}")


def components(spark: SparkSession, edges: DataFrame, cut: Cut) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root being the smallest node reachable.

    Each task first joins the edges it has, block by block, into stars. Then the large-star and small-star steps of
    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014) alternate until all is stars. A step joins
    edges with one minimum per node, so a hub's edges are never gathered in one place: minima are partial aggregates,
    written before they are joined, so that a hot side of the join can be split. Nodes without an edge to a different
    node are absent. Rows with a null end are ignored. Every round is written to the shared folder; the number of
    rounds is not limited, and every round that is not the last brings some node nearer to its smallest one. EDGES or fewer
    are joined by one task at once, so that small graphs take no rounds.
    """
    e = cut(_joined_stars(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct())
    while True:
        if e.count() <= EDGES:
            last = cut(_joined_stars(e.coalesce(1)))
            cut.drop(e)
            e = last
            break
        # stars: every u has one v, and no v is itself a u
        one = lambda c, is_u: e.select(F.col(c).alias("x"), F.lit(is_u).alias("is_u"))  # noqa: E731, B023
        bad = one("u", 1).unionByName(one("v", 0)).groupBy("x").agg(F.sum("is_u").alias("ups"), F.min("is_u").alias("low")).where("ups > 1 OR (ups > 0 AND low = 0)")
        if bad.limit(1).count() == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        cut.drop(low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v")
        new = cut(_joined_stars(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct())
        cut.drop(large, low, e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
