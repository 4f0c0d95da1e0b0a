"""SentencePiece merge models: encoding through a prefix table, decoding, and counts by pre-token."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_BYTES, Cut, bounded, slices

SPACE = "▁"
#: Entries after which a worker's caches start afresh; they only save time.
CACHE = 400_000
#: Different pre-tokens that a task counts before it passes them on, and half the pairs that it remembers while it counts their tokens.
COUNTED = 100_000
#: A pre-token is frequent if it makes up at least this part of all; so there are no more than the inverse of it.
#: Frequent ones of no more than HOT_CHARS characters have their counts broadcast; the others are joined.
HOT, HOT_CHARS = 1 / 800_000, 48
MAX_TOKENS = 4096


class Codec:
    """Encodes and decodes as the library does for a model of type BPE with the identity normalizer.

    For each prefix of a pre-token there is one last token of its encoding: the token t that ends the prefix such
    that t and the last token of what is before it are left alone when their texts are merged together. An
    Aho-Corasick automaton gives the tokens that end at each place; the table is filled from left to right and
    the ids are read from it backwards. The time is linear in the text.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normalizer and escaped white space")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.prefix, self.unk_text = norm.add_dummy_prefix, proto.trainer_spec.unk_surface.encode()
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.surface = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else self.unk_text if p.type == 2 else b"" for p in proto.pieces]
        self.is_byte = bytearray(p.type == 6 for p in proto.pieces)
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1 and self.merged(p) == [p]:  # others never end a prefix
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pattern = re.compile(self._pattern(), re.DOTALL)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, bytes] = {}

    def _pattern(self) -> str:
        """Pre-tokens: no piece reaches over their borders.

        A space symbol stands only at the beginning of pieces, so a border goes before each run of them; other
        neighbours must be next to each other in some piece, or linked through such characters.
        """
        multi = [p for p in self.score if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in multi):
            return ".+"
        of: dict[str, str] = {}

        def root(c: str) -> str:
            while of.setdefault(c, c) != c:
                of[c] = c = of[of[c]]
            return c

        for p in multi:
            p = p.lstrip(SPACE)
            for a, b in zip(p, p[1:], strict=False):
                of[root(a)] = root(b)
        groups: dict[str, list[str]] = {}
        for c in of:
            groups.setdefault(root(c), []).append(c)
        classes = "".join(f"[{''.join(map(re.escape, sorted(g)))}]+|" for g in sorted(groups.values(), key=lambda g: (-len(g), g)))
        return f"{SPACE}*(?:{classes}[^{SPACE}])|{SPACE}+"

    def normalized(self, text: str) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def pre_tokens(self, text: str | None) -> Iterable[str]:
        """The pre-tokens of a text; those of a long one are not held at once."""
        text = self.normalized(text or "")
        return self.pattern.findall(text) if len(text) < TEXT_BYTES // 16 else (m.group() for m in self.pattern.finditer(text))

    def merged(self, text: str) -> list[str]:
        """Best-scored merges first, leftmost among equals: the definition, for the few characters of two tokens."""
        parts, get = list(text), self.score.get
        scores = [get(text[i : i + 2]) for i in range(len(text) - 1)]
        live = [x for x in scores if x is not None]
        while live:
            i = scores.index(max(live))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i])
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1])
            live = [x for x in scores if x is not None]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the two tokens, merged together from their characters, come out as they are."""
        if len(self._pairs) >= 2 * CACHE:
            self._pairs.clear()
        found = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def tokens(self, text: str) -> list[str]:
        """The tokens of one pre-token."""
        n, known = len(text), self._pairs
        if n == 1:
            return [text]
        last: list[str | None] = [None] * (n + 1)  # None: the single character before
        for end, t in self.automaton.iter(text):
            if last[end + 1] is None:
                at = end + 1 - len(t)
                if at:
                    before = last[at] or text[at - 1]
                    fits = known.get((before, t))
                    if fits if fits is not None else self.compatible(before, t):
                        last[end + 1] = t
                else:
                    last[end + 1] = t
        out, i = [], n
        while i:
            t = last[i] or text[i - 1]
            out.append(t)
            i -= len(t)
        out.reverse()
        return out

    def packed(self, pre_token: str) -> bytes:
        """The ids of a pre-token as 32-bit integers."""
        found = self._cache.get(pre_token)
        if found is None:
            out = array("i")
            for t in self.tokens(pre_token):
                if (i := self.ids.get(t)) is not None:
                    out.append(i)
                elif self.byte:
                    out.extend(self.byte[b] for b in t.encode())
                else:
                    out.append(self.unk)
            found = out.tobytes()
            if len(pre_token) <= 64:
                if len(self._cache) >= CACHE:
                    self._cache.clear()
                self._cache[pre_token] = found
        return found

    def n_ids(self, pre_token: str) -> int:
        """The number of ids of a pre-token that is asked for once: nothing is kept but pairs."""
        return sum(1 if t in self.ids or not self.byte else len(t.encode()) for t in self.tokens(pre_token))

    def forget(self, pairs: int = 0) -> None:
        """Starts the caches afresh if they hold more pairs: a worker outlives its task, and a later one may not need them."""
        if len(self._pairs) > pairs or not pairs:
            self._pairs, self._cache = {}, {}

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.packed, self.pattern.findall(self.normalized(text or ""))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are not UTF-8 become U+FFFD, one for each byte, as in the library."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text, run = "", bytearray()
            for i in [*ids, None]:
                if i is not None and self.is_byte[i]:
                    run += self.surface[i]
                    continue
                text += _utf8(bytes(run))
                run.clear()
                text += self.surface[i].decode() if i is not None else ""
        first = next((i for i in ids if self.surface[i]), None)
        return text[1:] if self.prefix and first is not None and not self.is_byte[first] and first != self.unk and text.startswith(" ") else text


def _utf8(raw: bytes) -> str:
    out, i = "", 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out += raw[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out += "�"
            i += 1
    return out


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids, decoded`` of ``doc_id, text``; what a task has met goes with it."""
    c = codec(model)
    for batch in batches:
        for part in slices(batch):
            ids, ends, texts = [], [0], []
            for text in part.column(1).to_pylist():
                raw = c.encode(text)
                ids.append(raw)
                ends.append(ends[-1] + len(raw) // 4)
                texts.append(c.decode(memoryview(raw).cast("i").tolist()))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
            c.forget(2 * COUNTED)
    c.forget()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of each whole text: the model's ids, and the text that they decode to.

    path: of the model file, read on the driver. A null text is as an empty one, which has no ids. Rows that
    repeat each give a row, an empty table gives none; other columns are ignored. No shuffle; a task keeps the
    ids of pre-tokens it has met, up to a fixed number.
    """
    model = Path(path).read_bytes()
    bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, model), f"doc_id {kind}, ids array<int>, decoded string")


def _counted(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """``piece, n`` of the texts in the first column, passed on when more than COUNTED are held; a piece may come again."""
    c, seen = codec(model), Counter()
    give = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])
    for batch in batches:
        for text in batch.column(0):
            seen.update(c.pre_tokens(text.as_py()))
            if len(seen) >= COUNTED:
                yield give()
                seen = Counter()
    if seen:
        yield give()


def _sized(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """``piece, n, n_tokens`` of ``piece, n``; each piece comes once, so its ids are not kept."""
    c = codec(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.n_ids(x.as_py()) for x in batch.column(0)], pa.int64())], ["piece", "n", "n_tokens"])
        c.forget(2 * COUNTED)
    c.forget()


def vocabulary(texts: DataFrame, model: bytes) -> DataFrame:
    """``piece, n, n_tokens``: each distinct pre-token of all texts once, how often it occurs, and its tokens.

    Tasks count before they shuffle, and pass on what they have when it exceeds a fixed number of entries.
    """
    found = texts.select("text").mapInArrow(lambda batches: _counted(batches, model), "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(lambda batches: _sized(batches, model), "piece string, n long, n_tokens long")


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each whole text, without the ids of any text.

    Distinct pre-tokens are counted once and joined to each document's pre-token frequencies. Counts of frequent
    pre-tokens (1 / HOT of them at most, whatever the input, and of bounded length) are broadcast, which
    sums most of a text where it is read; the frequencies of all others are joined with the whole vocabulary, so
    that no frequent pre-token is gathered anywhere. A null text counts as an empty one. Rows that repeat are
    counted each; an empty table gives no rows; other columns are ignored.
    """
    cut, model = Cut(spark, "tokens"), Path(path).read_bytes()
    words = cut(vocabulary(docs, model))
    least = (words.agg(F.sum("n")).head()[0] or 0) * HOT
    often = words.where((F.col("n") >= least) & (F.length("piece") <= HOT_CHARS)).select("piece", "n_tokens").collect()  # at most 1 / HOT rows
    hot = spark.sparkContext.broadcast({x.piece: x.n_tokens for x in often})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known, key = codec(model), hot.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                keys, sizes, sums, ends, rare, often = [], [], [], [0], [], []
                for value in part.column(1):
                    text, total = value.as_py(), 0
                    for piece, n in Counter(c.pre_tokens(text)).items():
                        if (k := known.get(piece)) is not None:
                            total += n * k
                        else:
                            rare.append(piece)
                            often.append(n)
                    keys.append(key)
                    key += 1
                    sizes.append(len((text or "").encode()))
                    sums.append(total)
                    ends.append(len(rare))
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(often, pa.int64())], ["piece", "n"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc_id", "key", "n_bytes", "n_tokens", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, key long, n_bytes long, n_tokens long, rare array<struct<piece:string,n:long>>"))
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", F.col("r.piece").alias("piece"), F.col("r.n").alias("often"))
    rest = rare.join(words.select("piece", F.col("n_tokens").alias("k")), "piece").select("key", (F.col("often") * F.col("k")).alias("n_tokens"))
    none = F.lit(None)
    all_rows = rows.select("key", "doc_id", "n_bytes", "n_tokens").unionByName(rest.select("key", none.cast(kind).alias("doc_id"), none.cast("long").alias("n_bytes"), "n_tokens"))
    out = all_rows.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
