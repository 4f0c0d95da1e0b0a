"""Roles of transcript lines by a hidden Markov model, and canonical rendering of turns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, slices

ROLES = ("system", "user", "assistant")
#: States: a role's first line, and a later line of the same turn.
STATES = tuple((role, first) for role in ROLES for first in (True, False))
#: Rows, and lines, after which a conversation is cut; the cuts are joined exactly.
SEGMENT, SEGMENT_LINES = 512, 20_000
#: Scores are whole multiples of 2**-UNIT, so that sums over segments are the sums over all lines.
UNIT = 16
#: What a feature of a state is before counting, and as how many of the state's lines it weighs: this part of them, or so many.
PRIOR_SHARE, PRIOR_LINES = 0.01, 20
MARKED, ODD = 0.2, 1e-6
#: How often a turn begins within a row.
INNER = 0.1
# Names that transcripts begin a turn with, by role.
MARKERS = {"system": "system|instructions?|context", "user": "user|human|customer|question|q|me", "assistant": "assistant|ai|bot|agent|answer|a|model"}
FEATURES = ("marker", "opens", "start", "length", "lines", "question", "list")
_MARK = "^\\s*(?:#+\\s*|\\*\\*|<\\|?|\\[)?(?:{})(?:\\s*(?:\\*\\*)?\\s*:(?:\\*\\*)?|\\|?>|\\])"


def observations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, text)`` with ``seen``: for each line an array of small integers, one per feature.

    marker: the role that the line names at its beginning (0: none); opens: whether it is the first line of a
    row; start: whether the turn is the first of the conversation by number; length and lines: powers of two of
    the line's characters and the turn's lines; question: it ends with a question mark; list: it is an item.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    size = lambda n, top: F.least(F.lit(top), F.floor(F.log2(n + 1))).cast("int")

    def features(x: F.Column, i: F.Column) -> F.Column:
        marker = F.lit(0)
        for k, role in enumerate(ROLES):
            marker = F.when(F.lower(x).rlike(_MARK.format(MARKERS[role])), k + 1).otherwise(marker)
        opens = F.when(i == 0, 1).otherwise(0)
        start = F.when((i == 0) & (F.coalesce(F.col("turn"), F.lit(-1)) <= 0), 1).otherwise(0)
        return F.array(marker, opens, start, size(F.length(x), 12), size(F.size("_lines"), 6), F.when(x.rlike("\\?\\s*$"), 1).otherwise(0), F.when(x.rlike("^\\s*(?:[-*]|\\d+[.)])\\s"), 1).otherwise(0))

    return turns.withColumn("_lines", lines).withColumn("seen", F.transform("_lines", features)).drop("_lines")


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: dict[tuple[int, int, int], float]
    floor: dict[tuple[int, int], float]

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, steps and [feature, value, state] as whole numbers of 2**-UNIT. Values are below 16."""
        table = np.array([[[self.emit.get((s, f, v), self.floor[s, f]) for s in range(len(STATES))] for v in range(16)] for f in range(len(FEATURES))])
        return tuple(np.rint(x * 2.0**UNIT).astype(np.int64) for x in (self.start, self.step, table))


def line_scores(table: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """[line, state], for lines ``seen`` as [line, feature]."""
    return sum(table[f][seen[:, f]] for f in range(len(FEATURES)))


def fit(turns: DataFrame) -> Model:
    """Counts over all rows with a known role, smoothed by one; a table of states, features and values, whatever the input.

    Markers, and turns that begin within a row, may be rare or absent where roles are known, so their counts are joined
    to a prior of PRIOR_SHARE of the state's lines: a first line names its own role with probability MARKED, and INNER
    of the turns begin within a row. The turn after a turn is found by its number, so gaps in numbers only lose a
    count. An empty table, or one without known roles, gives the prior alone.
    """
    known = observations(turns.where(F.lower("role").isin(*ROLES)).select("conv_id", "turn", F.lower("role").alias("role"), "text"))
    n_lines = F.size("seen")
    each = known.select("role", F.posexplode("seen").alias("i", "line")).select("role", (F.col("i") == 0).alias("first"), F.posexplode("line").alias("f", "v"))
    emitted = each.groupBy("role", "first", "f", "v").count().collect()  # states * features * values
    inner = known.groupBy("role").agg(F.sum((n_lines > 1).cast("long")).alias("a"), F.sum(F.greatest(n_lines - 2, F.lit(0)).cast("long")).alias("b"), F.count("*").alias("n"), F.sum(F.when(n_lines == 1, 1).otherwise(0)).alias("one"), F.sum(F.when(F.coalesce("turn", F.lit(-1)) <= 0, 1).otherwise(0)).alias("starts")).collect()
    single = known.select("conv_id", "turn", "role", (n_lines == 1).alias("one"))
    after = single.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = single.join(after, ["conv_id", "turn"]).groupBy("role", "one", "next").count().collect()
    index = {s: i for i, s in enumerate(STATES)}
    n = len(STATES)
    start, step = np.full(n, -30.0), np.full((n, n), -30.0)
    begin, moves = np.zeros(n), np.zeros((n, n))
    for r in inner:
        begin[index[r["role"], True]] = r["starts"]
        moves[index[r["role"], True], index[r["role"], False]] += r["a"]
        moves[index[r["role"], False], index[r["role"], False]] += r["b"]
    for r in pairs:
        moves[index[r["role"], bool(r["one"])], index[r["next"], True]] += r["count"]
    firsts = [i for i, s in enumerate(STATES) if s[1]]
    start[firsts] = np.log((begin[firsts] + 1) / (begin[firsts] + 1).sum())
    for i, (role, _) in enumerate(STATES):
        can = [*firsts, index[role, False]]
        step[i, can] = np.log((moves[i, can] + 1) / (moves[i, can] + 1).sum())
    total: dict[tuple[int, int], int] = {}
    for r in emitted:
        k = index[r["role"], r["first"]], r["f"]
        total[k] = total.get(k, 0) + r["count"]
    emit = {(index[r["role"], r["first"]], r["f"], r["v"]): math.log((r["count"] + 1) / (total[index[r["role"], r["first"]], r["f"]] + 16)) for r in emitted}
    floor = {(s, f): math.log(1 / (total.get((s, f), 0) + 16)) for s in range(n) for f in range(len(FEATURES))}
    counted = {(index[r["role"], r["first"]], r["f"], r["v"]): r["count"] for r in emitted}
    for s, (role, first) in enumerate(STATES):
        own = {k: MARKED if first and other == role else ODD for k, other in enumerate(ROLES, 1)}
        for f, prior in ((0, {0: 1 - sum(own.values()), **own}), (1, {1: 1 - INNER, 0: INNER} if first else {1: ODD, 0: 1 - ODD})):
            lines = total.get((s, f), 0)
            weight = max(PRIOR_LINES, PRIOR_SHARE * lines)
            for v, x in prior.items():
                emit[s, f, v] = math.log((counted.get((s, f, v), 0) + weight * x) / (lines + weight))
    return Model(start, step, emit, floor)


def viterbi(start: np.ndarray, step: np.ndarray, scores: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[line, last state]: the best states of lines for each state that may be the last, the first on each tie from the end on.

    Also the states before the lines (-1: none), and the scores. before: of each state, the best score up to the line
    before (None: there is none).
    """
    n = len(start)
    back = np.empty((len(scores), n), np.int64)
    best = before
    for i, s in enumerate(scores):
        if best is None:
            back[i], best = -1, start + s
        else:
            to = best[:, None] + step
            back[i] = to.argmax(0)
            best = to.max(0) + s
    path = np.empty((len(scores), n), np.uint8)
    at = np.arange(n)
    for i in range(len(scores) - 1, -1, -1):
        path[i] = at
        at = back[i][at]
    return path, at, best


def transfer(start: np.ndarray, step: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """[state before, last state]: score of the best path through the lines; row 0 is for a conversation's beginning."""
    m = np.concatenate([start[None], step]) + scores[0]
    for s in scores[1:]:
        m = (m[:, :, None] + step[None]).max(1) + s
    return m


def _emit(out: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _numbered(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(c, conv_id, turn, text, seen)``, sorted, with ``seg, i, at``: their segment, place in it and first line's place in it.

    A segment's last row has in ``m`` its matrix of best scores, and in ``seg_lines`` what is seen of all its lines.
    """
    start, step, table = model.whole()
    names = ["c", "conv_id", "turn", "text", "seg", "i", "at", "lines", "m", "seg_lines"]

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, now, i, at, lines, held = TaskContext.get().partitionId() << 40, None, 0, 0, [], None

        def close(row: pa.RecordBatch) -> pa.RecordBatch:
            """The last row of a segment with what belongs to the segment."""
            whole = np.concatenate(lines)
            m = transfer(start, step, line_scores(table, whole)).ravel().tolist()
            return pa.RecordBatch.from_arrays([*row.columns[:8], pa.array([m], kinds[4]), pa.array([whole.tobytes()], kinds[5])], names)

        # the last row so far is held back until it is known whether its segment goes on
        for part in (p for batch in batches for p in slices(batch, "text")):
            own, seen = part.column(0).to_pylist(), part.column(4).to_pylist()
            place: list[list] = [[], [], [], []]
            ends = []
            for j, (c, x) in enumerate(zip(own, seen, strict=True)):
                if c != now or i >= SEGMENT or at >= SEGMENT_LINES:
                    if lines and j:
                        m = transfer(start, step, line_scores(table, whole := np.concatenate(lines)))
                        ends.append((j - 1, m.ravel().tolist(), whole.tobytes()))
                    elif lines:
                        yield close(held)
                        held = None
                    seg, now, i, at, lines = seg + 1, c, 0, 0, []
                lines.append(np.array(x, np.uint8))
                for values, v in zip(place, (seg, i, at, len(x)), strict=True):
                    values.append(v)
                i, at = i + 1, at + len(x)
            if held is not None:
                yield held
            m, whole = [None] * len(part), [None] * len(part)
            for j, a, b in ends:
                m[j], whole[j] = a, b
            out = pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(x, k) for x, k in zip((*place, m, whole), kinds, strict=True))], names)
            yield out.slice(0, len(out) - 1)
            held = out.slice(len(out) - 1)
        if held is not None:
            yield close(held)

    kind = {x: rows.schema[x].dataType.simpleString() for x in ("conv_id", "turn")}
    return rows.mapInArrow(run, f"c string, conv_id {kind['conv_id']}, turn {kind['turn']}, text string, seg long, i int, at int, lines int, m array<long>, seg_lines binary")


def _best_before(segments: DataFrame) -> DataFrame:
    """``c, seg, before, last``: of each segment of ``segments(c, seg, m)``, the best scores of states before it, and the best state at its end. Only the scores at hand are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            out = []
            for c, seg, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                m = np.array(m).reshape(-1, len(STATES))
                if c != now:
                    now, best = c, None
                before = None if best is None else best.tolist()
                best = m[0] if best is None else (best[:, None] + m[1:]).max(0)
                out.append((c, seg, before, int(best.argmax())))
            yield _emit(out, [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32()], ["c", "seg", "before", "last"])

    return segments.repartition("c").sortWithinPartitions("c", "seg").mapInArrow(run, "c string, seg long, before array<long>, last int")


def _paths(segments: DataFrame, model: Model) -> DataFrame:
    """``segments(c, seg, before, last, seg_lines)`` with, for each state that may be its last, the best path through it and the state before it."""
    start, step, table = model.whole()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                out = []
                for c, seg, before, last, raw in zip(*(x.to_pylist() for x in batch.slice(at, 64).columns), strict=True):
                    scores = line_scores(table, np.frombuffer(raw, np.uint8).reshape(-1, len(FEATURES)))
                    path, back, _ = viterbi(start, step, scores, None if before is None else np.array(before))
                    out.append((c, seg, last, [path[:, a].tobytes() for a in range(len(STATES))], back.tolist()))
                yield _emit(out, [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32())], ["c", "seg", "last", "paths", "from"])

    return segments.mapInArrow(run, "c string, seg long, last int, paths array<binary>, from array<int>")


def _last_states(paths: DataFrame) -> DataFrame:
    """``seg, after``: the state at each segment's end, from a conversation's last segment to its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, -1
        for batch in batches:
            out = []
            for c, seg, last, back in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != now:
                    now, state = c, last
                out.append((seg, state))
                state = back[state]
            yield _emit(out, [pa.int64(), pa.int32()], ["seg", "after"])

    return paths.repartition("c").sortWithinPartitions("c", F.desc("seg")).select("c", "seg", "last", "from").mapInArrow(run, "seg long, after int")


def parse_roles(spark: SparkSession, turns: DataFrame, model: Model) -> DataFrame:
    """``conv_id, turn, part, text, role_found``: the turns in the rows of ``turns(conv_id, turn, text)``.

    A conversation's lines in order of turn (nulls first), then of a hash of the text, get the states of greatest joint
    probability. A row is one turn with its first line's role, unless the path enters a first line within it: there
    it is split, and ``part`` numbers the pieces from 0. A null text is one empty line and stays null. Rows with a
    null conv_id are conversations of their own; rows that repeat follow each other; an empty table gives no rows;
    other columns are ignored.

    Rows are dealt by ranges of conversation and place, and cut into segments of so many rows or lines; so a long
    conversation, or a row that is repeated often, is spread over tasks. A segment gives a matrix of best scores from
    the state before it to its last one. Going through a conversation's matrices, a few numbers for each segment,
    gives the scores before each segment; with these each segment finds its best path to each last state, and going
    through them from the end picks one. Scores are whole numbers, so this is the path of one pass over all lines,
    wherever the cuts are, ties included.
    """
    cut = Cut(spark, "transcripts")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", "text", F.monotonically_increasing_id().alias("_n"))
    rows = rows.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.concat(F.lit("null/"), F.col("_n").cast("string")))).withColumn("_h", text_hash)
    place = ["c", "turn", "_h", "_n"]
    rows = observations(rows).repartitionByRange(*place).sortWithinPartitions(*place)
    rows = cut(_numbered(rows.select("c", "conv_id", "turn", "text", "seen"), model))
    segments = rows.where("m IS NOT NULL").select("c", "seg", "m", "seg_lines")
    before = cut(_best_before(segments.select("c", "seg", "m")))
    paths = cut(_paths(segments.join(before, ["c", "seg"]).select("c", "seg", "before", "last", "seg_lines"), model))
    after = cut(_last_states(paths))
    chosen = paths.join(after, "seg").select("seg", F.element_at("paths", F.col("after") + 1).alias("path"))
    each = rows.select("seg", "i", "at", "lines").join(chosen, "seg").select("seg", "i", F.substring("path", F.col("at") + 1, F.col("lines")).alias("states"))
    return _split(rows.select("seg", "i", "conv_id", "turn", "text").join(each, ["seg", "i"]).select("conv_id", "turn", "text", "states"))


def _split(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in slices(batch):
                owner, part, texts, roles = [], [], [], []
                for i, (text, states) in enumerate(zip(whole.column(2).to_pylist(), whole.column(3).to_pylist(), strict=True)):
                    cuts = [0, *(j for j in range(1, len(states)) if STATES[states[j]][1])]
                    lines = None if text is None else text.split("\n")
                    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(states)], strict=True)):
                        owner.append(i)
                        part.append(k)
                        texts.append(None if lines is None else "\n".join(lines[a:b]))
                        roles.append(STATES[states[a]][0])
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([whole.column(0).take(take), whole.column(1).take(take), pa.array(part, pa.int32()), pa.array(texts, pa.string()), pa.array(roles, pa.string())], ["conv_id", "turn", "part", "text", "role_found"])

    kind = {x: rows.schema[x].dataType.simpleString() for x in ("conv_id", "turn")}
    return rows.mapInArrow(run, f"conv_id {kind['conv_id']}, turn {kind['turn']}, part int, text string, role_found string")


def render(turns: DataFrame) -> DataFrame:
    """``turns(..., text, role_found)`` with ``rendered``: the turn in canonical form, without the marker that it began with."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    for role in ROLES:
        plain = F.when(F.col("role_found") == role, F.regexp_replace(plain, "(?i)" + _MARK.format(MARKERS[role]), "")).otherwise(plain)
    return turns.withColumn("rendered", F.concat(F.lit("<|"), F.col("role_found"), F.lit("|>\n"), F.trim(plain), F.lit("\n<|end|>\n")))
