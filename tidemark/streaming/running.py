"""Running a stream to its present end, at once or as its input grows, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import fresh


def source(spark: SparkSession, path: str, new_only: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet table, a file or a folder, with its schema. new_only: of files that are written from now on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # the file source takes folders: of a single file, the folder and a pattern that is the file's own name
    out = reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString()) if is_file else reader.parquet(path)
    return out.where(F.col("_metadata.file_modification_time") >= F.lit(datetime.now(UTC).replace(microsecond=0))) if new_only else out


def _run(df: DataFrame, at: str, mode: str) -> None:
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{at}/out")
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out"))
    q.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for the input that is there now, through a table in the shared folder. The query is complete when this returns."""
    at = fresh(df.sparkSession, name)
    _run(df, at, mode)
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def kept_states(spark: SparkSession, result: DataFrame) -> int:
    """How many series the states of a ``stepped`` stream of ``stateful`` hold after its last trigger."""
    groups = spark.read.format("statestore").load(result._state_path)
    return groups.agg(F.coalesce(F.sum(F.size("value.groupState.parts")), F.lit(0))).head()[0]


def stepped(spark: SparkSession, steps: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives whose input grows by steps.

    Before each trigger a step's rows are added to the input folder; the query is then started again from its
    checkpoint, takes the new files alone, and goes on with the state that earlier triggers left.
    """
    at, out = fresh(spark, name), None
    for rows in steps:
        rows.write.mode("append").parquet(f"{at}/in")
        out = build(source(spark, f"{at}/in"))
        _run(out, at, mode)
    result = spark.read.schema(out.schema).parquet(f"{at}/out")
    result._state_path = f"{at}/state"
    return result
