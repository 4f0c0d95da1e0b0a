"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text: str | None, k: int = 3) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text: str | None, k: int) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def removed(texts, length: int = 200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, sha(np.frombuffer(r, np.uint8)[~gone].tobytes())))
    return out


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(text: str | None):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def targets(sizes: dict) -> dict:
    """Sources' words by weight 5, 2, 1, stopped at three times the source, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, total = {}, set(order), float(sum(sizes.values()))
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in left}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    return out


def guess_cost(value: str, words: tuple[str, ...] = ()) -> float:
    """The least cost over all cuts, from the cost of every substring as one segment."""
    import math

    from tidemark.llm import secrets

    rank = {}
    for w in (*secrets.FIRST, *words):
        rank.setdefault(w, len(rank) + 1)
    key = lambda c: c.lower().translate(secrets.UNSHIFT)

    def shifts(s):
        up = [c != key(c) for c in s]
        return secrets.SHIFT * (up[0] + sum(a != b for a, b in zip(up, up[1:], strict=False)))

    def segment(a, b):
        s, n = value[a:b], b - a
        low, out = s.lower(), []
        if n == 1:
            out.append(math.log10(10 if s.isdigit() else 26 if s.isascii() and s.isalpha() else 33))
        if n >= 3:
            r = rank.get(low) or 4 * rank.get(low.translate(secrets.LEET), 0)
            if r:
                out.append(math.log10(r) + secrets.SHIFT * (0 if s == low else 1 if s.istitle() or s.isupper() else n) + secrets.JOIN)
            k = "".join(map(key, s))
            if any(k in x or k in x[::-1] for x in secrets.LINES):
                out.append(secrets.LINE + n * secrets.STEP + shifts(s) + secrets.JOIN)
            ways = [secrets.ADJACENT.get(x) for x in zip(k, k[1:], strict=False)]
            if None not in ways:
                out.append(secrets.WALK + 2 * secrets.STEP + sum(secrets.STEP if x == y else secrets.TURN for x, y in zip(ways, ways[1:], strict=False)) + shifts(s) + secrets.JOIN)
        if n == 4 and re.fullmatch(r"(19|20)[0-9]{2}", s):
            out.append(secrets.YEAR + secrets.JOIN)
        for sep in ("", "-", "/", "."):
            for form in ("{y:04}{s}{m:02}{s}{d:02}", "{d:02}{s}{m:02}{s}{y:04}"):
                m = re.fullmatch(re.escape(form.format(y=7777, m=88, d=99, s=sep)).replace("7777", "(?P<y>[0-9]{4})").replace("88", "(?P<m>[0-9]{2})").replace("99", "(?P<d>[0-9]{2})"), s)
                if m and 1900 <= int(m["y"]) <= 2099 and 1 <= int(m["m"]) <= 12 and 1 <= int(m["d"]) <= 31:
                    out.append(secrets.DAY + secrets.JOIN)
        for p in range(1, min(secrets.UNIT, a) + 1):
            if n >= max(p, 2) and all(value[j] == value[j - p] for j in range(a, b)):
                out.append(math.log10(p + 1) + n * secrets.STEP + secrets.JOIN)
        return min(out, default=math.inf)

    best = [0.0]
    for b in range(1, len(value) + 1):
        best.append(min(best[a] + segment(a, b) for a in range(b)))
    return best[-1]


def all_spans(text: str | None, words: tuple[str, ...] = ()):
    """Base spans and the values in a credential's place that cost much, by their definition, on characters rather than bytes."""
    from tidemark.llm import secrets

    t, base = text or "", base_spans(text)
    context, named = (re.compile(x.pattern.decode(), re.A) for x in (secrets.CONTEXT, secrets.NAMED))
    covered = set()
    for _, a, z in base:
        covered |= set(range(a, z))
    out, at = [(a, k, z) for k, a, z in base], 0
    while m := context.search(t, at):
        value, a = m[2].rstrip(".!?)]}"), m.start(2)
        at = a if named.fullmatch(m[2]) else m.end()
        prose = m[1] and (value.islower() or value.istitle() or value.isupper() or not value.isascii()) and secrets.PROSE.fullmatch(value.lower())
        joined = {tuple(x) for x in _runs(covered)}
        if len(value.encode()) >= 6 and not any(x <= a and a + len(value) <= y for x, y in joined) and not prose and guess_cost(value, words) >= 9:
            out.append((a, "guess", a + len(value)))
    order = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
    return [(k, a, z) for a, k, z in sorted(out, key=lambda x: (x[0], order[x[1]]))]


def _runs(places: set[int]):
    out: list[list[int]] = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return out


def redacted(text: str | None, words: tuple[str, ...] = ()) -> str | None:
    """Every character of a span goes; the kind of the first span of each run of overlapping ones stands for it."""
    out, last = [], 0
    for k, a, z in all_spans(text, words):
        if a >= last:
            out += [text[last:a], f"<{k}>"]
        last = max(last, z)
    return "".join([*out, text[last:]]) if out else text
