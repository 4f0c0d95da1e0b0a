"""Secret scans: fixed patterns, and values whose guessing would cost an attacker much."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

#: A value in a credential's place is a secret if guessing it takes 10**MIN_COST tries or more.
MIN_COST = 9.0

# Words that guessers of passwords try first, in order. Words of a vocabulary file come after them.
FIRST = """password admin welcome login master secret token letmein user root guest test example sample default
changeme dragon monkey football baseball sunshine princess shadow superman batman trustno qwerty iloveyou
access private public server client database system service account session cookie bearer basic oauth
company office summer winter spring autumn january february march april june july august september october
november december monday tuesday wednesday thursday friday saturday sunday michael jennifer thomas jordan
hunter buster soccer hockey killer george charlie andrew michelle love jessica pepper daniel joshua maggie
starwars computer freedom whatever ginger ninja mustang hello world mother father brother sister house
green blue red black white yellow orange purple silver golden string value name none null true false
your here enter insert replace placeholder xxxx redacted hidden dummy fake todo""".split()
# Orders of keys that are run through, in either direction; none has a key twice.
LINES = (
    "abcdefghijklmnopqrstuvwxyz", "0123456789", "1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm",
    "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik,9ol.0p;/", "zaq1xsw2cde3vfr4bgt5nhy6mju7,ki8.lo9", "qazwsxedcrfvtgbyhnujmikolp", "zaqxswcdevfrbgtnhymju", "1q2w3e4r5t6y7u8i9o0p", "q1w2e3r4t5y6u7i8o9p0", "147258369", "789456123",
)
# The rows of a keyboard, each a little to the right of the one above; and what shift makes of its keys.
KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED, PLAIN = '!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./"
# Letters that digits and signs stand for.
LEET = str.maketrans("@4380!1|57$", "aaebollltss")

#: log10 of the ways to choose: that a segment begins, a place on a line, a key and a direction, the next key in the same way, another way, shift for other keys.
JOIN, LINE, WALK, STEP, TURN, SHIFT = math.log10(2), 2.0, 2.2, math.log10(1.1), math.log10(5), math.log10(2)
#: A date without and with day and month.
YEAR, DAY = math.log10(150), math.log10(366 * 150)
#: Part of the model of costs, as the longest word is: a unit that is repeated has at most so many characters, for any number of times; a longer one is priced by its parts.
UNIT = 32
LEAST = 3
DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")


def _on_lines() -> dict[tuple[str, str], tuple[int, ...]]:
    """Of two neighbours on lines: the lines, with their directions, on which the second follows the first."""
    out: dict[tuple[str, str], list[int]] = {}
    for k, line in enumerate(x for line in LINES for x in (line, line[::-1])):
        for a, b in zip(line, line[1:], strict=False):
            out.setdefault((a, b), []).append(k)
    return {x: tuple(sorted(set(own))) for x, own in out.items()}


def _adjacent() -> dict[tuple[str, str], int]:
    """Of two neighbours on the keyboard: the direction from the first to the second."""
    at = {c: (x, y) for y, row in enumerate(KEYS) for x, c in enumerate(row)}
    by = {place: c for c, place in at.items()}
    ways = ((1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (1, -1))
    return {(c, by[x + dx, y + dy]): d for c, (x, y) in at.items() for d, (dx, dy) in enumerate(ways) if (x + dx, y + dy) in by}


ON_LINES, ADJACENT = _on_lines(), _adjacent()
UNSHIFT = str.maketrans(SHIFTED, PLAIN)


@lru_cache(maxsize=4)
def ranked(words: tuple[str, ...] = ()) -> tuple[dict[str, int], int]:
    """Ranks of words, FIRST before others, and the length of the longest."""
    rank: dict[str, int] = {}
    for w in (*FIRST, *words):
        rank.setdefault(w, len(rank) + 1)
    return rank, max(map(len, rank))


def vocabulary(path: str) -> tuple[str, ...]:
    """Whole words of three letters or more in a tokenizer file, in its order: frequent ones first. Read on the driver."""
    ids = json.loads(Path(path).read_bytes())["model"]["vocab"]
    whole = (t.removesuffix("</w>").lower() for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    return tuple(dict.fromkeys(w for w in whole if len(w) >= LEAST and w.isascii() and w.isalpha()))


def _char(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33)


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """Of each start: ends and periods of the maximal runs in which each character is the one a period before, for a period or more."""
    x = np.array([ord(c) for c in value], np.uint32)
    out: dict[int, list[tuple[int, int]]] = {}
    for p in range(1, min(UNIT, len(x) // 2) + 1):
        same = np.concatenate([[0], (x[p:] == x[:-p]).astype(np.int8), [0]])
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
            if b - a >= max(p, 2):
                out.setdefault(a + p, []).append((b + p, p))
    return out


def guess_cost(value: str, words: tuple[str, ...] = ()) -> float:
    """log10 of the tries that guessing a value takes: the least over all ways of cutting it into segments.

    A segment is

    - a word: its rank, twice that as Title or UPPER, 2**length for other mixes, four times for look-alike signs;
    - a date: a year, or a year with month and day in one of two orders;
    - a repeat: two characters or more, and a period or more, that are each the same as the one a period before
      (so ``abcabc`` is what ``abc`` costs and a repeat); a period, then STEP a character;
    - a line: three characters or more in the order of the alphabet, of digits, of a keyboard's rows or columns, in
      either direction: LINE, then STEP a character and SHIFT where shift changes;
    - a walk over neighbouring keys, three or more: WALK, then STEP for a key in the same direction, TURN for one in
      another, and SHIFT where shift changes;
    - a character by brute force.

    All but the last cost JOIN besides. best[i] is the least cost of the first i characters. Costs of lines, walks and
    repeats add up by characters, so the least over all their starts is kept up as they are extended: that is exact,
    and linear in the length.
    """
    rank, longest = ranked(words)
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain, keys = low.translate(LEET), low.translate(UNSHIFT)
    shift = [c != k for c, k in zip(value, keys, strict=True)]
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[tuple[int, float]]] = {}
    for m in (m for i in range(n) if value[i].isdigit() and (m := DATE.match(value, i))):
        dates.setdefault(m.end(), []).append((m.start(), YEAR if m.end() - m.start() == 4 else DAY))
        if m.end() - m.start() > 4 and value[m.start() : m.start() + 2] in ("19", "20") and value[m.start() : m.start() + 4].isdecimal():
            dates.setdefault(m.start() + 4, []).append((m.start(), YEAR))
    runs, repeats = _repeats(value), []  # of open repeats: end, period, first character, least cost
    lines: dict[int, tuple[int, float]] = {}  # of open lines: characters, least cost
    walk, two, way = math.inf, math.inf, -1  # least costs of walks of three keys or more, and of two
    for i in range(1, n + 1):
        c = best[i - 1] + _char(value[i - 1])
        for size in range(LEAST, min(longest, i) + 1):
            word = low[i - size : i]
            r = rank.get(word)
            if r is None and (r := rank.get(plain[i - size : i])) is not None:
                r *= 4
            if r is not None:
                raw = value[i - size : i]
                c = min(c, best[i - size] + math.log10(r) + (0 if raw == low[i - size : i] else SHIFT if raw.istitle() or raw.isupper() else SHIFT * size) + JOIN)
        for start, cost in dates.get(i, ()):
            c = min(c, best[start] + cost + JOIN)
        if i > 1:
            pair, turned = (keys[i - 2], keys[i - 1]), SHIFT * (shift[i - 1] != shift[i - 2])
            begun = SHIFT * shift[i - 3] + SHIFT * (shift[i - 2] != shift[i - 3]) + turned if i > 2 else 0.0
            now = {}
            for k in ON_LINES.get(pair, ()):
                size, cost = lines.get(k, (1, math.inf))
                cost += STEP + turned
                if size >= 2:
                    cost = min(cost, best[i - 3] + LINE + LEAST * STEP + begun + JOIN)
                    c = min(c, cost)
                now[k] = size + 1, cost
            lines = now
            to = ADJACENT.get(pair)
            if to is None:
                walk = two = math.inf
            else:
                walk = min(walk, two) + (STEP if to == way else TURN) + turned
                two = best[i - 2] + WALK + 2 * STEP + SHIFT * shift[i - 2] + turned + JOIN
                c = min(c, walk)
            way = -1 if to is None else to
        still = []
        for end, p, first, cost in repeats:
            least = max(p, 2)
            cost += STEP
            if i - first >= least:
                cost = min(cost, best[i - least] + math.log10(p + 1) + least * STEP + JOIN)
                c = min(c, cost)
            if i < end:
                still.append((end, p, first, cost))
        repeats = still
        best[i] = c
        repeats += [(end, p, i, math.inf) for end, p in runs.get(i, ())]
    return best[n]


ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
STEMS = re.compile(rb"pass|pwd|secret|token|api|auth|bearer|credential|access")
NAME = rb"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?)"
#: A credential's name, on its own or as the end of a compound, then a sign or "is", then perhaps a scheme, then a value up to a space or closing sign.
CONTEXT = re.compile(rb"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:" + NAME + rb"[\"']?(?:[\x20\t]*(?::|=>?|->)[\x20\t]*|([\x20\t]+is:?[\x20\t]+))[\"'`]?(?:(?:bearer|basic|token)[\x20\t]+)?[\"'`]?)([^\x00-\x20\"'`<>,;]{6,})")
#: A value that is a name itself, with its sign.
NAMED = re.compile(rb"(?i:(?:[a-z0-9]+[_-])*" + NAME + rb")(?::|=>?|->)?")
#: Behind "is", what is built like a word of prose is no value: one way of writing, no long runs of consonants or vowels.
PROSE = re.compile(r"(?!.*[b-df-hj-np-tv-xz]{5})(?!.*[aeiou]{4})(?:[a-z]|[^\W\d_a-zA-Z]){1,18}")
KINDS = ("assign", "access", "hex", "guess")


def scan(text: str | None, min_cost: float = MIN_COST, words: tuple[str, ...] = ()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, cost) of each secret of a whole text, by start, then kind; in code points, end exclusive.

    cost: of a guess, log10 of its tries, else 0. A guess is a value that base spans do not
    cover whole; it may overlap them.
    """
    raw = (text or "").encode()
    low, found = raw.lower(), []
    if STEMS.search(low):
        found += [(0, m.start(), m.end(), 0.0) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(1, m.start(), m.end(), 0.0) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), 0.0) for m in HEX.finditer(raw)]
    if STEMS.search(low):
        base, at = [], 0
        for a, b in sorted((a, b) for _, a, b, _ in found):
            if base and a <= base[-1][1]:
                base[-1][1] = max(b, base[-1][1])
            else:
                base.append([a, b])
        m = CONTEXT.search(raw)
        while m:
            start, value = m.start(2), raw[m.start(2) : m.end(2)].rstrip(b".!?)]}")
            while at < len(base) and base[at][1] <= start:
                at += 1
            if len(value) >= 6 and not (at < len(base) and base[at][0] <= start and start + len(value) <= base[at][1]):
                said = value.decode(errors="replace")
                cost = guess_cost(said, words)
                if cost >= min_cost and not (m[1] and (said.islower() or said.istitle() or said.isupper() or not said.isascii()) and PROSE.fullmatch(said.lower())):
                    found.append((3, start, start + len(value), cost))
            m = CONTEXT.search(raw, m.start(2) if NAMED.fullmatch(m[2]) else m.end())
    found.sort(key=lambda x: (x[1], x[0]))
    if len(raw) != len(text or ""):
        place, last, n = {}, 0, 0
        for p in sorted({p for _, a, b, _ in found for p in (a, b)}):
            n += len(raw[last:p].decode())
            place[p] = n
            last = p
        found = sorted(((k, place[a], place[b], c) for k, a, b, c in found), key=lambda x: (x[1], x[0]))
    return [(KINDS[k], a, b, c) for k, a, b, c in found]


def _words(docs: DataFrame, path: str | None):
    """The vocabulary on all executors: no more than the file has entries."""
    return docs.sparkSession.sparkContext.broadcast(vocabulary(path) if path else ())


def find_secrets(docs: DataFrame, path: str | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """``doc_id, spans`` of every row, spans being array<struct<kind, start, end, cost>> as ``scan`` gives them.

    path: a tokenizer file whose whole words are guessed too. A null or empty text has no spans. Rows that repeat
    each give a row, an empty table gives none; other columns are ignored. No shuffle; one text at a time.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())])
    words = _words(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = [[dict(zip(("kind", "start", "end", "cost"), x, strict=True)) for x in scan(t.as_py(), min_cost, words.value)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,cost:double>>")


def redact(docs: DataFrame, path: str | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """``docs`` with each secret replaced by its kind in angle brackets; overlapping spans are replaced as one.

    A null text stays null, as do texts without secrets what they are; rows that repeat stay so, and an empty table
    gives none. ``n_chars``, if there, follows the new text. Texts go through Python in parts of bounded size.
    """
    words = _words(docs, path)
    bounded(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        out, last = [], 0
        for k, a, b, _ in scan(text, min_cost, words.value):
            if a >= last:
                out += [text[last:a], f"<{k}>"]
            last = max(last, b)
        return "".join([*out, text[last:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            for part in slices(batch):
                yield part.set_column(i, part.schema.field(i), pa.array((clean(t.as_py()) for t in part.column(i)), pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
