"""The pipeline's stages and its whole against a brute-force version."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import DATA
from tidemark.llm import secrets


def test_run_against_brute_force(spark, documents):
    rows = {r["doc_id"]: r for r in documents.collect()}
    kept = sorted(i for i, r in rows.items() if not brute.quality(r["text"])[-1])
    sets = [brute.shingles(rows[i]["text"], 5) for i in kept]
    root = brute.components(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    kept = sorted({kept[r] for r in root})
    words = secrets.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    text = {i: brute.redacted(rows[i]["text"], words) for i in kept}
    size, source = {i: len(brute.WORD.findall(t)) for i, t in text.items()}, {i: rows[i]["source"] for i in kept}
    total, largest = Counter(), Counter()
    for i in kept:
        total[source[i]] += size[i]
        largest[source[i]] = max(largest[source[i]], size[i])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, DATA).collect()
    times, taken = Counter(r["doc_id"] for r in out), Counter()
    for r in out:
        ids = sp.encode(text[r["doc_id"]])
        assert (r["ids"], r["n_tokens"], r["decoded_sha256"]) == (ids, len(ids), brute.sha(sp.decode(ids)))
    for i, n in times.items():
        assert n <= 3
        taken[source[i]] += n * size[i]
    for s, t in brute.targets(total).items():
        assert abs(taken[s] - t) <= largest[s]


def test_stages_keep_the_columns(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, DATA).columns == documents.columns


def test_stages_take_awkward_and_empty_tables(spark, awkward, nothing):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    quality, near, secret, mix, encode = (stage for _, stage in corpus_pipeline.STAGES)
    docs = awkward.select(*columns)
    rows = docs.collect()
    key = lambda r: (repr(r["doc_id"]), r["text"] or "")
    clean = spark.createDataFrame([(1000 + i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "clean", None) for i in range(60)], docs.schema)
    good = sorted(key(r) for r in rows if not brute.quality(r["text"])[-1])
    found = sorted(key(r) for r in quality(spark, docs.union(clean), DATA).collect() if r["source"] != "clean" or r["doc_id"] is None)
    assert Counter(found) <= Counter(good)  # hosts may take more
    assert quality(spark, docs.union(clean), DATA).where("source = 'clean'").count() == 60
    sets = [brute.shingles(r["text"], 5) for r in rows]
    root = brute.components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    least = {r: min((x["doc_id"] for x, y in zip(rows, root, strict=True) if y == r and x["doc_id"] is not None), default=None) for r in set(root)}
    assert Counter(r["doc_id"] for r in near(spark, docs, DATA).collect()) == Counter(least.values())
    words = secrets.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r["doc_id"], r["text"]) for r in secret(spark, docs, DATA).collect()) == Counter((r["doc_id"], brute.redacted(r["text"], words)) for r in rows)
    assert max(Counter(key(r) for r in mix(spark, docs, DATA).collect()).values()) <= 3 * max(Counter(map(key, rows)).values())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in encode(spark, docs, DATA).collect()) == Counter((r["doc_id"], len(sp.encode(r["text"] or ""))) for r in rows)
    for stage in (quality, near, secret, mix, encode):
        assert stage(spark, nothing.select(*columns), DATA).count() == 0
