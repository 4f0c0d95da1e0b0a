"""The queries of this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, mixing, pieces, quality, secrets, sharding, simhash, suffixes, transcripts
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = transcripts.render(transcripts.parse_roles(spark, turns.select("conv_id", "turn", "text"), transcripts.fit(turns)))
    return out.select("conv_id", "turn", "part", "role_found", "rendered")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "block", "mix_shards")


def op10_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_OP3 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT *, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(w) - 3)) AS i FROM m),
r AS (SELECT doc_id, i FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS k FROM r) GROUP BY doc_id),
b AS (SELECT m.doc_id, m.source, n::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN c ON m.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS k, sum(base_failed::INT)::DOUBLE AS x FROM f GROUP BY source),
s AS (SELECT sum(k) AS n, sum(x) / sum(k) AS m, sum(x * x / k) - sum(x) ^ 2 / sum(k) AS q, count(*) AS j, sum(k * k) AS n2 FROM h),
v AS (SELECT *, CASE WHEN n - n2 / n = 0 THEN NULL ELSE (q - (j - 1) * m * (1 - m)) / (n - n2 / n) END AS v FROM s),
p AS (SELECT m, least(1e6, greatest(1.0, coalesce(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 END, 1e6))) AS z FROM v)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (h.x + m * z) / (h.k + z) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _OP3}
