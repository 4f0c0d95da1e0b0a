from __future__ import annotations

import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


#: A row for each awkward case, with columns whose names operators use themselves.
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, spans string, rows long, edge boolean, target double, n_words long"


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(1)
    words = ["alpha", "béta", "gamma", "Delta,", "日本語", "x=1", "token", "#", "line\nbreak", "é"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, same = prose(30_000), prose(80)
    texts = [None, "", " ", " \t\n ", "a", same, same, same + " end", long, "x" * 100_000, " " * 5_000, "\n".join(["one two three four five six"] * 40), 'password = "x7$Kq9!zLm2"', "AKIA" + "B" * 20, "f" * 64, "\x00\x01", "▁ a▁b", prose(300)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 3 == 0 else len(t or ""), None, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, same, None, None, *[None] * 9), (None, None, *[None] * 11)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)
