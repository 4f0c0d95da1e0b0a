"""Series in files: columnar or JSON, with a choice of compression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..series import Series

FORMATS = {"binary": "parquet", "json": "json"}
CODECS = {"parquet": {"none": "none", "gzip": "gzip", "lz4": "lz4_raw", "zstd": "zstd"}, "json": {"none": "none", "gzip": "gzip", "lz4": "lz4"}}


def write(s: Series, path: str, kind: str = "binary", compression: str = "none", clustered: bool = True) -> None:
    """Rows by partition and key within each file if ``clustered``, so that readers can skip row groups by key."""
    form = FORMATS[kind]
    df = s.to_df()
    if clustered:
        df = df.sortWithinPartitions(*s.node.on())
    df.write.format(form).option("compression", CODECS[form][compression]).mode("error").save(path)


def read(spark: SparkSession, path: str, part: tuple[str, ...] = (), kind: str = "binary", schema: str | None = None) -> Series:
    reader = spark.read.format(FORMATS[kind])
    df = (reader.schema(schema) if schema else reader).load(path)
    return Series.of(df, "k", "v", part)
