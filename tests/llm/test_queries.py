"""The registered queries against SQL, against plain versions, and against the libraries."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__
from tests.llm import brute
from tests.llm.conftest import DATA
from tests.oracle import assert_same
from tidemark.llm import mixing, secrets, sharding, transcripts
from tidemark.llm import queries as llm

QUERIES = llm.queries()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, QUERIES[name], llm.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= {*__spark_entry__.queries()}


def by_id(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, DATA).collect()}


def test_op1(spark, texts):
    ids = sorted(texts)
    fps = [brute.fingerprint(texts[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = brute.components(len(ids), links)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in by_id(spark, "op1_simhash_neardup").items()} == {i: (f"{fps[n]:016x}", ids[root[n]]) for n, i in enumerate(ids)}


@pytest.mark.parametrize("planted", [False, True])
def test_op2(spark, tmp_path, planted):
    at, rows = DATA, spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    if planted:  # the tables of this folder have no links
        at, rng = f"file://{tmp_path}", np.random.default_rng(17)
        new = [(100_000 + 50 * i + j, r["label"], [float(x) for x in np.array(r["embedding"]) + rng.normal(size=len(r["embedding"])) * s * np.std(r["embedding"])]) for i, r in enumerate(rows[:40]) for j, s in enumerate([0, 0.02, 0.05, 0.1] + [0.08] * (30 if i == 0 else 0))]
        spark.createDataFrame([*map(tuple, rows), *new], "vec_id long, label string, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
        rows = spark.read.parquet(f"{at}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = brute.components(len(rows), list(zip(*np.nonzero(near), strict=True)))
    ids = [r["vec_id"] for r in rows]
    least = {c: min(i for i, r in zip(ids, root, strict=True) if r == c) for c in set(root)}
    want = {i: (int(n), least[c], least[c] == i) for i, n, c in zip(ids, near.sum(1), root, strict=True)}
    got = {r["vec_id"]: r for r in QUERIES["op2_lattice_neardup"](spark, at).collect()}
    assert want == {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()}
    assert planted == (sum(not kept for _, _, kept in want.values()) > 100)


def test_op4_roles_of_held_out_conversations(spark):
    turns = spark.read.parquet(f"{DATA[:-5]}0.01/conversations.parquet")
    found = transcripts.parse_roles(spark, turns.where("conv_id % 2 = 1").select("conv_id", "turn", "text"), transcripts.fit(turns.where("conv_id % 2 = 0")))
    both = found.join(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"]).collect()
    assert len(both) >= turns.where("conv_id % 2 = 1").count() and sum(r["role"] == r["role_found"] for r in both) >= 0.9 * len(both)


def plain_lines(turn, text):
    """What is seen of each line, by the definition of the features."""
    lines, out = (text or "").split("\n"), []
    for i, x in enumerate(lines):
        marker = 0
        for k, role in enumerate(transcripts.ROLES, 1):
            if re.search(rf"^\s*(#+\s*|\*\*|<\|?|\[)?({transcripts.MARKERS[role]})(\s*(\*\*)?\s*:(\*\*)?|\|?>|\])", x.lower(), re.A):
                marker = k
        starts = i == 0 and (-1 if turn is None else turn) <= 0
        out.append((marker, i == 0, starts, min(12, int(math.log2(len(x) + 1))), min(6, int(math.log2(len(lines) + 1))), bool(re.search(r"\?\s*$", x)), bool(re.search(r"^\s*([-*]|\d+[.)])\s", x))))
    return [tuple(map(int, x)) for x in out]


def test_op4_against_all_paths(spark, tmp_path):
    """Each conversation of the query has the best of all paths over its lines, and its rows are split and rendered by it."""
    rng = random.Random(18)
    kinds = ["Hello there?", "User: what now", "- an item", "Assistant: this", "A long line of words that goes on and on for a while.", "system: rules", "yes"]
    rows = [(c, t, ("user", "assistant")[t % 2] if c % 3 else None, "\n".join(rng.choices(kinds, k=rng.randrange(1, 3)))) for c in range(25) for t in range(rng.randrange(1, 3))]
    at = f"file://{tmp_path}"
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{at}/conversations.parquet")
    start, step, table = transcripts.fit(turns).whole()
    n, want = len(transcripts.STATES), []
    for c in range(25):
        own = [(t, text) for k, t, _, text in rows if k == c]
        seen = [x for t, text in own for x in plain_lines(t, text)]
        scores = [[sum(int(table[f][v][s]) for f, v in enumerate(x)) for s in range(n)] for x in seen]
        value = lambda p: start[p[0]] + scores[0][p[0]] + sum(step[a, b] + scores[i][b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False), 1))  # noqa: E731, B023
        path = max(itertools.product(range(n), repeat=len(seen)), key=lambda p: (value(p), tuple(-s for s in reversed(p))))
        for t, text in own:
            lines, mine, path = text.split("\n"), path[: text.count("\n") + 1], path[text.count("\n") + 1 :]
            cuts = [0, *(j for j in range(1, len(mine)) if transcripts.STATES[mine[j]][1]), len(mine)]
            for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                role, body = transcripts.STATES[mine[a]][0], "\n".join(lines[a:b])
                body = re.sub(r"(?i)^(user|assistant|system):", "", body) if body.lower().startswith(f"{role}:") else body
                want.append((c, t, k, role, f"<|{role}|>\n{body.strip(' ')}\n<|end|>\n"))
    assert sorted(map(tuple, QUERIES["op4_transcript_roles"](spark, at).collect())) == sorted(want)
    assert any(k for _, _, k, _, _ in want)


def test_op5_and_op6(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: sp.encode(t or "") for i, t in texts.items()}
    want = {i: (len(x), brute.sha(",".join(map(str, x))), brute.sha(sp.decode(x))) for i, x in ids.items()}
    assert {i: tuple(r)[1:] for i, r in by_id(spark, "op5_piece_codec").items()} == want
    assert {i: tuple(r)[1:] for i, r in by_id(spark, "op6_token_counts").items()} == {i: (len((texts[i] or "").encode()), len(x), len(x) > 4096) for i, x in ids.items()}


def test_op7(spark, texts):
    ids = sorted(texts)
    want = dict(zip(ids, brute.removed([texts[i] for i in ids]), strict=True))
    assert {i: tuple(r)[1:] for i, r in by_id(spark, "op7_suffix_dedup").items()} == want


def test_op8(spark, texts):
    words = secrets.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in by_id(spark, "op8_secret_scan").items():
        base = brute.base_spans(texts[i])
        kinds = [k for k, _, _ in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), brute.sha(brute.joined(base)))
        assert r["spans"] == brute.joined(brute.all_spans(texts[i], words))


def test_op9(spark, documents):
    source = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in documents.select("doc_id", "text").collect()}
    total, taken, got = defaultdict(int), defaultdict(int), by_id(spark, "op9_mix_sources")
    for i, n in size.items():
        total[source[i]] += n
    want = brute.targets(total)
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]]) and r["target"] == pytest.approx(want[source[i]])
        assert r["taken"] in [k * size[i] for k in range(4)]
        taken[source[i]] += r["taken"]
    assert got == by_id(spark, "op9_mix_sources")
    largest = defaultdict(int)
    for i, n in size.items():
        largest[source[i]] = max(largest[source[i]], n)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert all(r["taken"] == size[i] * len(r["mix_shards"]) for i, r in got.items())
    blocks = {}
    for i, r in got.items():
        at = source[i], r["block"]
        blocks[at] = max(blocks.get(at, []), r["mix_shards"], key=len)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    draws = [sum(len(x) for (s, _), x in blocks.items() if s == t) for t in order]
    dealt = mixing.split_quotas(draws, mixing.SHARDS)
    if all(blocks.values()):
        for n, t in enumerate(order):
            of = [k for (s, _), x in blocks.items() if s == t for k in x]
            assert sum(abs(of.count(k) - dealt[k][n]) for k in range(mixing.SHARDS)) == 0


def test_op10(spark, texts):
    got = by_id(spark, "op10_shard_slots")
    places = defaultdict(list)
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        places[r["shard"]].append(r["slot"])
    assert set(got) == set(texts) and all(sorted(p) == list(range(len(p))) for p in places.values())
    load, balanced = defaultdict(int), defaultdict(int)
    for r in got.values():
        load[r["vslot"]] += r["size"]
        balanced[r["balanced_shard"]] += r["size"]
    now = sharding.SlotMap.of(40)
    then = now.rebalance(load)
    before = defaultdict(int)
    for r in got.values():
        assert (r["slot_bytes"], r["map_version"], r["balanced_version"]) == (load[r["vslot"]], now.version, now.version + 1)
        assert (r["shard"], r["balanced_shard"]) == (now.shards[r["vslot"]], then.shards[r["vslot"]])
        before[r["shard"]] += r["size"]
    assert max(balanced.values()) <= max(before.values())
