"""Hashes that Spark lacks, in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reflected polynomial of CRC-32C.
POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def crc32c_bytes(rows: list[bytes | None], seed: int = 0) -> np.ndarray:
    """CRC-32C of many byte strings at once, a byte of all of them in each step; null counts as empty."""
    raw = [r or b"" for r in rows]
    order = np.argsort([-len(r) for r in raw], kind="stable")
    sizes = np.array([len(raw[i]) for i in order])
    out = np.full(len(raw), seed ^ 0xFFFFFFFF, np.uint32)
    if len(raw):
        joined = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        live = len(raw)
        for at in range(int(sizes[0])):
            while live and sizes[live - 1] <= at:
                live -= 1
            b = joined[start[:live] + at]
            out[:live] = _TABLE[(out[:live] ^ b) & 0xFF] ^ (out[:live] >> np.uint32(8))
    result = np.empty(len(raw), np.int64)
    result[order] = (out ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return result


@F.pandas_udf(T.LongType())
def crc32c(text: pd.Series) -> pd.Series:
    return pd.Series(crc32c_bytes([x.encode() if isinstance(x, str) else x for x in text]))


def xxh64(text: Column, seed: int = 42) -> Column:
    """XXH64 of a string's UTF-8, as a signed number. Spark has it natively for the seed 42."""
    if seed == 42:
        return F.xxhash64(text)

    @F.pandas_udf(T.LongType())
    def run(text: pd.Series) -> pd.Series:
        from xxhash import xxh64_intdigest

        return text.map(lambda x: None if x is None else (xxh64_intdigest(x.encode(), seed) + 2**63) % 2**64 - 2**63)

    return run(text)


@F.pandas_udf(T.StringType())
def blake2b(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=32).hexdigest())
