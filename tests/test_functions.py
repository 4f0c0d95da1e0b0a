from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import hashes, numeric, timekeys
from tidemark.sources import encodings


def test_crc32c_known_values():
    assert hashes.crc32c_bytes([b"123456789", b"", None, b"a" * 32]).tolist()[:3] == [0xE3069283, 0, 0]


def test_parse_decimal(spark):
    df = spark.createDataFrame([("123.45600",), ("2.5e-002",), ("x",)], "t string").select(numeric.parse_decimal(F.col("t"), 18, 5))
    assert [None if r[0] is None else float(r[0]) for r in df.collect()] == [123.456, 0.025, None]


def test_weeks_begin_on_mondays(spark):
    df = spark.range(40).select(timekeys.frame_start(F.col("id") * 86_400_000_000, "day", 7).alias("w"))
    assert all((dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r["w"])).weekday() == 0 for r in df.collect())


def test_skipped_local_time_is_refused(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS t")
    assert df.select(timekeys.zone_to_utc(F.col("t"), "ny")).count() == 1
    try:
        df.select(timekeys.zone_to_utc(F.col("t"), "ny", strict=True)).collect()
    except Exception as e:  # noqa: BLE001
        assert "skipped or repeated" in str(e)
    else:
        raise AssertionError("not refused")


def test_byte_shuffle():
    raw = bytes(range(23))
    out = encodings._dealt(raw, 4, False)
    assert out[:5] == bytes([0, 4, 8, 12, 16]) and encodings._dealt(out, 4, True) == raw
