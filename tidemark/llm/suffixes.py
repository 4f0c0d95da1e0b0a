"""Removing long repeated byte strings: anchored candidates, ordered by deep-shallow suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, slices

LENGTH = 200
#: Anchors are GRAM-byte strings; each window of LENGTH bytes has one, the one of least hash, wherever it occurs.
GRAM = 32
SPAN = LENGTH - GRAM
#: Different surroundings of one anchor that a task sorts together; more are first told apart by the bytes next to it.
GROUP = 16_384
#: Window starts that are handled together, in each round of telling the anchors of larger groups apart.
WIDTHS = (57, 8, 1)
#: Depth to which suffixes are sorted by multikey quicksort before blind tries take over.
SHALLOW = 48
BLOCK = 1 << 19
ROWS = 8192

_B = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + LENGTH, _B)]), dtype=np.uint64)
_INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + LENGTH, np.uint64(pow(int(_B), -1, 1 << 64)))]), dtype=np.uint64)


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over each window of a size: running values from both ends of fixed blocks."""
    n, fill = len(x), x[-1:]
    y = np.concatenate([x, np.repeat(fill, -n % size)]).reshape(-1, size)
    head = op.accumulate(y, axis=1).ravel()
    tail = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - size + 1], head[size - 1 : n])


def anchors(buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of anchors in bytes; ``last``: for each place, the end of its document.

    In each window, all grams of least hash are anchors, so the choice depends on the window's bytes alone.
    """
    places, found = [], []
    starts = len(buf) - LENGTH + 1
    for s in range(0, starts, BLOCK):
        t = min(s + BLOCK, starts) - s
        part = buf[s : s + t + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(part * _POW[: len(part)], dtype=np.uint64)])
        h = (total[GRAM:] - total[:-GRAM]) * _INV[: len(part) - GRAM + 1]
        for shift, by in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB), (29, 0)):
            h ^= h >> np.uint64(shift)
            if by:
                h *= np.uint64(by)
        h |= np.uint64(1)
        low = _sliding(h, SPAN + 1, np.minimum)
        low[last[s : s + t] - np.arange(s, s + t) < LENGTH] = 0  # a window over a document's end counts for nothing
        none = np.zeros(SPAN, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([none, low, none]), SPAN + 1, np.maximum) == h)
        places.append(at + s)
        found.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(found)[first]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of about a block of bytes, with their texts; one text may be longer."""
    col, at, own, size = batch.column(batch.schema.get_field_index("text")), 0, [], 0
    for i in range(len(batch)):
        raw = (col[i].as_py() or "").encode()
        own.append(raw)
        size += len(raw)
        if size >= BLOCK or i == len(batch) - 1:
            yield at, i + 1, own
            at, own, size = i + 1, [], 0


def _anchored(own: list[bytes]):
    lengths = np.array([len(x) for x in own], np.int64)
    ends = np.cumsum(lengths)
    whole = b"".join(own)
    places, h = anchors(np.frombuffer(whole, np.uint8), np.repeat(ends, lengths))
    return whole, places, h.view(np.int64), np.searchsorted(ends, places, side="right"), ends - lengths, ends


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])]


def anchor_keys(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, own in _texts(batch):
                k, n = np.unique(_anchored(own)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long")


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``rid, key, ctx, pos, right, n, more``: anchors by text, key and surroundings.

    ctx is a 128-bit hash of the surroundings: up to SPAN bytes before the anchor and LENGTH from it, within the text. Of a
    text's anchors that agree in key and ctx there is one row, of the first; n is how many there are, and more
    holds the surroundings of the others, as merged intervals.
    """
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for _, _, own in _texts(batch):
                whole, places, key, doc, first, end = _anchored(own)
                if not len(places):
                    continue
                left, right = np.minimum(places - first[doc], SPAN), np.minimum(end[doc] - places, LENGTH)
                raw = b"".join([xxh3_128_digest(whole[p - a : p + b], a) for p, a, b in zip(places.tolist(), left.tolist(), right.tolist(), strict=True)])
                ctx = np.frombuffer(raw, np.int64).reshape(-1, 2)
                order = np.lexsort((places, ctx[:, 1], ctx[:, 0], key, doc))
                same = np.concatenate([[False], (np.diff(doc[order]) == 0) & (np.diff(key[order]) == 0) & (np.diff(ctx[order], axis=0) == 0).all(1)])
                head = np.flatnonzero(~same)
                count = np.diff(np.concatenate([head, [len(order)]]))
                more: list[list | None] = [None] * len(head)
                for j in np.flatnonzero(count > 1):
                    rest = order[head[j] + 1 : head[j] + count[j]]
                    f = first[doc[rest]]
                    a, b = _merged(places[rest] - left[rest] - f, places[rest] + right[rest] - f)
                    more[j] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                rids = [hashlib.md5(x, usedforsecurity=False).digest() for x in own]
                o = order[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rids[i] for i in doc[o]], pa.binary()), pa.array(key[o]), pa.array([raw[16 * i : 16 * i + 16] for i in o.tolist()], pa.binary()), pa.array((places - first[doc])[o].astype(np.int32)), pa.array(right[o].astype(np.int32)), pa.array(count), pa.array(more, spans)],
                    ["rid", "key", "ctx", "pos", "right", "n", "more"],
                )

    return docs.select("text").mapInArrow(run, "rid binary, key long, ctx binary, pos int, right int, n long, more array<struct<start:int,end:int>>")


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(items: list[int], text: list[bytes]) -> list[int]:
    """Items in the order of their texts, which share a long prefix, through a trie that stores branching bytes alone.

    A new text goes down by its branching bytes without looking at what is between them, to some leaf; one
    comparison with the leaf's text shows where the new text leaves the path, and there it branches off.
    """
    END = -1
    root: list | int = items[0]  # an inner node: [depth, {byte: node}]
    for new in items[1:]:
        s, node = text[new], root
        while isinstance(node, list):
            b = s[node[0]] if node[0] < len(s) else END
            node = node[1].get(b)
            if node is None:
                break
        if node is None:  # any leaf below the node where the way ended will do
            node = root
            while isinstance(node, list):
                b = s[node[0]] if node[0] < len(s) else END
                node = node[1].get(b) if b in node[1] else next(iter(node[1].values()))
        other = text[node if isinstance(node, int) else node[0]]
        d = _lcp(s, other)
        if d == len(s) == len(other):
            d += 1  # equal texts part behind their end, as leaves under one node
        parent, at, node = None, None, root
        while isinstance(node, list) and node[0] < d:
            parent, at = node, s[node[0]] if node[0] < len(s) else END
            node = node[1][at] if at in node[1] else None
        byte = lambda t: t[d] if d < len(t) else END
        if isinstance(node, list) and node[0] == d:
            key = byte(s)
            if key in node[1] or d > len(s):
                key = min([END, *node[1]]) - 1
            node[1][key] = new
            continue
        if d > len(s):
            made = [d, {END: node, END - 1: new}]
        else:
            made = [d, {byte(other): node, byte(s): new}]
        if parent is None:
            root = made
        else:
            parent[1][at] = made
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(child for _, child in sorted(node[1].items(), key=lambda x: -x[0]))
        else:
            out.append(node)
    return out


def deep_shallow(groups: list[list[int]], text: list[bytes], depth: int = 0) -> list[int]:
    """Items of each group, in turn, ordered by text: multikey quicksort to SHALLOW bytes, then a blind trie.

    depth: of a prefix that the texts of a group are known to share.
    """
    out: list[int] = []
    stack = [(g, depth) for g in reversed(groups)]
    while stack:
        own, d = stack.pop()
        if len(own) == 1:
            out.append(own[0])
        elif d >= max(SHALLOW, depth):
            out.extend(blind_trie(own, text))
        else:
            byte = [text[i][d] if d < len(text[i]) else -1 for i in own]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less = [i for i, b in zip(own, byte, strict=True) if b < pivot]
            equal = [i for i, b in zip(own, byte, strict=True) if b == pivot]
            more = [i for i, b in zip(own, byte, strict=True) if b > pivot]
            if more:
                stack.append((more, d))
            if pivot < 0:
                stack.append((equal, SHALLOW + depth))  # texts that have ended are equal
            else:
                stack.append((equal, d + 1))
            if less:
                stack.append((less, d))
    return out


def repeated_levels(sub: np.ndarray, left: list[bytes], right: list[bytes], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, the least and the greatest level at which its window equals that of another of its group (-1: none).

    sub: groups, in order. left: the bytes before an anchor, reversed; right: those from it on. The window of
    level l has the l bytes before the anchor and LENGTH - l from it on; low <= l <= high. Two windows of a level
    are equal if the reversed left parts share l bytes and the right parts LENGTH - l. Both sides are put in
    suffix order; runs of the common-prefix lengths between neighbours give the classes that share so many bytes,
    and a window repeats if another anchor is in the same two classes.
    """
    n = len(sub)
    edges = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1], [True]]))
    groups = [list(range(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    orders = []
    for text, depth in ((left, 0), (right, GRAM)):
        order = deep_shallow(groups, text, depth)
        near = [-1] * n
        for j in range(1, n):
            a, b = order[j - 1], order[j]
            if sub[a] == sub[b]:
                near[j] = _lcp(text[a], text[b])
        orders.append((np.array(order), np.array(near)))
    (by_left, lcp_left), (by_right, lcp_right) = orders
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    # no window of an anchor repeats beyond the most that it shares with a neighbour on each side
    most = np.zeros((2, n), np.int64)
    for side, (order, near) in enumerate(orders):
        most[side, order] = np.maximum(near, np.append(near[1:], -1))
    begin, end = np.maximum(low, LENGTH - most[1]), np.minimum(high, most[0])
    first, last = np.full(n, -1), np.full(n, -1)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for level in range(low, high + 1):
        ok = np.flatnonzero((begin <= level) & (level <= end) & (n_left >= level) & (n_right >= LENGTH - level))
        if len(ok) < 2:
            continue
        a[by_left] = np.cumsum(lcp_left < level)
        b[by_right] = np.cumsum(lcp_right < LENGTH - level)
        both = a[ok] * (n + 1) + b[ok]
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        hit = ok[order[np.append(same, False) | np.concatenate([[False], same])]]
        last[hit] = level
        hit = hit[first[hit] < 0]
        first[hit] = level
    return first, last


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, ctx, n, k, left, bytes`` of anchors ``wanted(rid, key, ctx, n, k, pos, right)``: the surroundings themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts, lists = part.column(0).to_pylist(), part.column(1)
                owner = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()[: len(part) + 1]))
                rows = lists.flatten()
                key, ctx, n, k, pos, right = (rows.field(x) for x in ("key", "ctx", "n", "k", "pos", "right"))
                raw = [t.encode() for t in texts]
                p, r = pos.to_numpy(), right.to_numpy()
                around = [raw[i][a:b] for i, a, b in zip(owner.tolist(), np.maximum(p - SPAN, 0).tolist(), (p + r).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key, ctx, n, k, pa.array(np.minimum(p, SPAN).astype(np.int32)), pa.array(around, pa.binary())], ["key", "ctx", "n", "k", "left", "bytes"])

    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "ctx", "n", "k", "pos", "right")).alias("rows"))  # no more than a text has anchors
    one = docs.select(_rid().alias("rid"), "doc_id", "text")
    holder = docs.select(_rid().alias("r"), "doc_id").groupBy("r").agg(F.min(F.struct("doc_id")).alias("d"))
    lists = lists.join(holder, F.col("rid") == F.col("r")).select("rid", "rows", F.col("d.doc_id").alias("_d"))
    found = one.join(lists, "rid").where(F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "rows")
    return found.mapInArrow(run, "key long, ctx binary, n long, k long, left int, bytes binary")


def _rid() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _zones(rows: DataFrame, width: int) -> DataFrame:
    """Of each context, for each run of ``width`` levels within its own: ``sub``, what the run's windows have in common, and ``zone``, all that they cover, both as hashes.

    ``rows(key, ctx, n, left, bytes, low, high)``; the result has low and high of the run, and in first and last
    those of its levels that the context has windows for.
    """
    names = ["sub", "zone", "key", "ctx", "n", "low", "high", "first", "last"]
    types = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for start in range(0, len(batch), 1000):
                out = []
                for key, ctx, n, left, raw, low, high in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns), strict=True):
                    right = len(raw) - left
                    for a in range(low, high + 1, width):
                        b = min(a + width - 1, high)
                        if b < LENGTH - right or a > left:
                            continue
                        z0 = max(0, left - b)
                        core = raw[max(0, left - a) : left + LENGTH - b]
                        zone = raw[z0 : left + LENGTH - a]
                        out.append((xxh3_128_digest(core, (key ^ a) & (2**64 - 1)), xxh3_128_digest(zone, left - z0), key, ctx, n, a, b, max(a, LENGTH - right), min(b, left)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.select("key", "ctx", "n", "left", "bytes", "low", "high").mapInArrow(run, "sub binary, zone binary, key long, ctx binary, n long, low int, high int, first int, last int")


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """``sub, zone, first, last``: levels at which ``rows(sub, zone, left, bytes, low, high)`` of a group repeat one another; a group has GROUP rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(own: list[tuple]) -> pa.RecordBatch:
            sub = [r[0] for r in own]
            number = np.cumsum([0, *(x != y for x, y in zip(sub, sub[1:], strict=False))])
            first, last = np.full(len(own), -1), np.full(len(own), -1)
            runs = np.array([(r[4], r[5]) for r in own])
            for low, high in np.unique(runs, axis=0).tolist():
                at = np.flatnonzero((runs[:, 0] == low) & (runs[:, 1] == high))
                first[at], last[at] = repeated_levels(number[at], [own[i][3][: own[i][2]][::-1] for i in at], [own[i][3][own[i][2] :] for i in at], low, high)
            hit = np.flatnonzero(first >= 0)
            return pa.RecordBatch.from_arrays([pa.array([own[i][0] for i in hit], pa.binary()), pa.array([own[i][1] for i in hit], pa.binary()), pa.array(first[hit].astype(np.int32)), pa.array(last[hit].astype(np.int32))], ["sub", "zone", "first", "last"])

        for batch in (b.slice(at, 1024) for b in batches for at in range(0, len(b), 1024)):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= ROWS:
                keep = len(held) - 1
                while keep and held[keep - 1][0] == held[-1][0]:
                    keep -= 1
                if keep:
                    yield done(held[:keep])
                    held = held[keep:]
        if held:
            yield done(held)

    return rows.repartition("sub").sortWithinPartitions("sub").select("sub", "zone", "left", "bytes", "low", "high").mapInArrow(run, "sub binary, zone binary, first int, last int")


def repeated_spans(spark: SparkSession, docs: DataFrame, cut: Cut) -> DataFrame:
    """``rid, spans``: of texts (by MD5) with bytes to be removed, intervals that cover them."""
    # counts and levels are written before they are joined, so that the many rows of one key can be split between tasks
    n_keys = cut(anchor_keys(docs).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    rows = cut(anchor_rows(docs).join(n_keys, "key"))
    contexts = cut(rows.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "pos", "right")).alias("p")))
    several = cut(contexts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"))
    # surroundings that occur twice repeat at all their levels
    hits = [contexts.where("n > 1").select("key", "ctx", F.greatest(F.lit(0), LENGTH - F.col("p.right")).alias("first"), F.least(F.lit(SPAN), F.col("p.pos")).alias("last"))]
    cut.drop(n_keys)
    wanted = contexts.join(several, "key").select("key", "ctx", "n", "k", "p.rid", "p.pos", "p.right")
    around = cut(_contexts(docs, wanted))
    low, high = F.lit(0).alias("low"), F.lit(SPAN).alias("high")
    key = F.to_binary(F.lpad(F.hex("key"), 16, "0"), F.lit("hex"))
    few = around.where(F.col("k") <= GROUP).select(key.alias("sub"), F.col("ctx").alias("zone"), "left", "bytes", low, high)
    found = cut(_sorted_groups(few))
    hits.append(found.select(F.conv(F.hex("sub"), 16, -10).cast("long").alias("key"), F.col("zone").alias("ctx"), "first", "last"))
    left_over = around.where(F.col("k") > GROUP).select("key", "ctx", "n", "left", "bytes", low, high)
    for width in WIDTHS if left_over.limit(1).count() else ():
        zones = cut(_zones(left_over, width))
        each = zones.groupBy("sub", "zone").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("ctx").alias("ctx"), *(F.min(x).alias(x) for x in ("low", "high", "first", "last")))
        each = cut(each)
        sizes = cut(each.groupBy("sub").agg(F.count("*").alias("k")).where("k > 1"))
        same = each.where("n > 1").select("sub", "zone", "first", "last")
        if width > 1:
            few = each.join(sizes.where(F.col("k") <= GROUP), "sub").select("sub", "zone", "key", "ctx", "low", "high")
            few = few.join(around.select("key", "ctx", "left", "bytes"), ["key", "ctx"]).select("sub", "zone", "left", "bytes", "low", "high")
            same = same.unionByName(_sorted_groups(few))
        same = cut(same.groupBy("sub", "zone").agg(F.min("first").alias("first"), F.max("last").alias("last")))
        hits.append(cut(zones.select("key", "ctx", "sub", "zone").join(same, ["sub", "zone"]).select("key", "ctx", "first", "last")))
        many = sizes.where(F.col("k") > GROUP)
        if width == 1 or many.limit(1).count() == 0:
            break
        left_over = zones.join(many, "sub").select("key", "ctx", "n", "low", "high").join(around.select("key", "ctx", "left", "bytes"), ["key", "ctx"])
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    out = cut(out.groupBy("key", "ctx").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("last >= first"))
    own = F.array(F.struct((F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + LENGTH).alias("end")))
    spans = rows.join(out, ["key", "ctx"]).select("rid", F.explode(F.concat(own, F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")))).alias("s")).distinct()
    return spans.groupBy("rid").agg(F.collect_list("s").alias("spans"))  # no more than a text has anchors


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, spans`` of every row.

    Removed is each byte covered by a string of LENGTH bytes that also starts elsewhere, in the same text or
    another; kept (binary, since a cut may part a character) holds the other bytes. Strings are judged on the
    input. A null text counts as an empty one. Repeated rows are documents that repeat each other. Other columns
    are ignored, an empty table gives no rows.

    Each window of LENGTH bytes holds an anchor that its bytes alone decide, so equal windows share an anchor
    with the same place in them, and only texts around anchors met twice are compared. Equal surroundings are
    counted, not compared; different ones of one anchor are put in suffix order in a task of their own group. A
    group too large for that is told apart by longer strings around shorter runs of window starts, down to the
    windows themselves, where only counting is left; so no group is gathered, and none is left out.
    """
    cut = Cut(spark, "suffixes")
    docs = docs.select("doc_id", "text")
    spans = cut(repeated_spans(spark, docs, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, removed, parts, keeps = [], [], [], []
            for i in range(len(batch)):
                raw, found = (batch.column(1)[i].as_py() or "").encode(), batch.column(2)[i].as_py()
                a, b = _merged(np.array([x["start"] for x in found]), np.array([x["end"] for x in found])) if found else ((), ())
                out, last = [], 0
                for x, y in zip(a, b, strict=True):
                    out.append(raw[last:x])
                    last = y
                kept = b"".join([*out, raw[last:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                parts.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                keeps.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(keeps, pa.binary()), pa.array(parts, kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = docs.withColumn("_rid", _rid()).join(spans, F.col("_rid") == F.col("rid"), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")
