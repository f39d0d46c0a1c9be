"""Chat formatting: roles recovered from transcripts by a hidden Markov model, then rendered canonically.

A transcript's lines emit what their speaker marker says (none, a name for the
user, for the assistant, for the system, or some other name) and how the line
looks (its length, a question mark, whether it follows an empty line). The
hidden states are the three roles, each as the first line of a turn or a later
one. Viterbi decoding in log space gives the roles; lines of one turn are
joined and turns rendered as ``<|role|>`` blocks.

A transcript's lines are decoded in segments of up to ``SEGMENT`` lines. A
segment's max-plus transition matrix stands for it, so a transcript of any
length is decoded in parallel and exactly: chaining the matrices gives each
segment the states at its two ends, and the segments then decode alone. A
second chain, of the segments' numbers of turns and lines, gives every turn its
number; only numbers are chained, never text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROLES = ("system", "user", "assistant")
SEGMENT = 512
#: Lines of a turn that one row of the result holds.
PIECE = 512

#: Names that speakers go by.
_NAMES = {
    "system": 0, "sys": 0, "instructions": 0, "instruction": 0, "prompt": 0,
    "user": 1, "human": 1, "question": 1, "q": 1, "customer": 1, "me": 1, "you": 1, "student": 1,
    "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "agent": 2, "model": 2, "chatbot": 2, "teacher": 2,
}
_MARKER = re.compile(r"^\s*(?:<\|?(\w{1,20})\|?>|\[(\w{1,20})\]|\*{0,2}(\w{1,20})\*{0,2}\s?[:>]\*{0,2}|#{1,4}\s*(\w{1,20})\s*:?\s*$)\s*")

#: Markers: 0 none, 1 + role for a known name, 4 for another name.
_MARKERS = 5
#: States: role + 3 * (0 for a turn's first line, 1 for a later one).
_STATES = 6


def marker(line: str) -> tuple[int, int]:
    """What a line's speaker marker says, and where the text after it begins."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    name = next(g for g in m.groups() if g).lower()
    return (1 + _NAMES[name], m.end()) if name in _NAMES else (4, 0)


def _log(rows) -> np.ndarray:
    p = np.array(rows, float)
    return np.log(p / p.sum(-1, keepdims=True))


#: First line of a turn, then later lines: how likely each marker is.
EMIT_MARKER = _log(
    [
        [8, 90, 0.5, 0.5, 1],
        [12, 0.5, 84, 0.5, 3],
        [12, 0.5, 0.5, 84, 3],
        [97, 0.2, 0.2, 0.2, 2.4],
        [97, 0.2, 0.2, 0.2, 2.4],
        [97, 0.2, 0.2, 0.2, 2.4],
    ]
)
#: Looks: short or long, by question or not, by after an empty line or not.
EMIT_LOOK = _log(
    [
        [10, 1, 2, 0.5, 30, 3, 6, 1.5],
        [7, 5, 1.5, 1, 21, 15, 4.5, 3],
        [6, 1.5, 7, 1, 18, 4.5, 21, 3],
        [40, 2, 28, 2, 4, 0.3, 2, 0.3],
        [36, 11, 14, 5, 3, 1, 1.5, 0.5],
        [34, 4, 38, 2, 3, 0.4, 3.5, 0.4],
    ]
)
#: From each state to each: a later line follows its own role; a turn is followed by another's.
STEP = _log(
    [
        [0.5, 8, 1, 30, 1e-9, 1e-9],
        [0.2, 1, 24, 1e-9, 20, 1e-9],
        [0.2, 24, 1, 1e-9, 1e-9, 40],
        [0.5, 8, 1, 30, 1e-9, 1e-9],
        [0.2, 1, 24, 1e-9, 20, 1e-9],
        [0.2, 24, 1, 1e-9, 1e-9, 40],
    ]
)
START = _log([10, 80, 10, 1e-9, 1e-9, 1e-9])


def emissions(lines: list[str], after_empty: list[bool]) -> np.ndarray:
    out = np.empty((len(lines), _STATES))
    for i, (line, gap) in enumerate(zip(lines, after_empty)):
        look = 2 * (len(line) > 240) + ("?" in line[-3:]) + 4 * gap
        out[i] = EMIT_MARKER[:, marker(line)[0]] + EMIT_LOOK[:, look]
    return out


def bridge(e: np.ndarray) -> np.ndarray:
    """Best score from each state before a segment, and from a start (the last row), to each state at its end."""
    best = np.vstack([STEP, START]) + e[0]
    for row in e[1:]:
        best = (best[:, :, None] + STEP[None]).max(1) + row
    return best


def viterbi(e: np.ndarray, before: int | None, end: int | None = None) -> np.ndarray:
    """The best states of a segment, given the state before it (none: a start) and its last."""
    best = (START if before is None else STEP[before]) + e[0]
    back = np.zeros((len(e), _STATES), np.int64)
    for i in range(1, len(e)):
        total = best[:, None] + STEP
        back[i] = total.argmax(0)
        best = total.max(0) + e[i]
    out = np.empty(len(e), np.int64)
    out[-1] = best.argmax() if end is None else end
    for i in range(len(e) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def decode(lines: list[str]) -> list[int]:
    """The states of all lines of one transcript, in one piece (the plain form)."""
    gaps = [i > 0 and not lines[i - 1].strip() for i in range(len(lines))]
    held = [i for i, line in enumerate(lines) if line.strip()]
    return viterbi(emissions([lines[i] for i in held], [gaps[i] for i in held]), None).tolist() if held else []


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the schema's columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


_SEGMENT = "conv_id long, shard int, segment int, whole boolean, trail boolean, lines array<string>, gaps binary, bridge binary, gapped binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into segments of one conversation's lines; blank lines only leave their mark.

    whole: the segment is all of its conversation. trail: blank lines come after
    it. What a task has of its first and last conversation may go on in others;
    its first line may then follow a blank one there, so its segment has the
    bridges of both cases.
    """
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    conv, begun, first, gap, number, start = None, False, True, False, 0, 0
    lines: list[str] = []
    gaps: list[bool] = []
    held: list[list] = []  # of the conversation in hand
    done: list[list] = []

    def flush() -> None:
        nonlocal lines, gaps, number
        if lines:
            e = emissions(lines, gaps)
            # Only the first line that a task has of a conversation can follow a blank line elsewhere.
            other = np.concatenate([emissions(lines[:1], [True]), e[1:]]) if number == start and not gaps[0] else None
            held.append([conv, shard, number, False, False, lines, bytes(map(int, gaps)), bridge(e).tobytes(), None if other is None else bridge(other).tobytes()])
            number += 1
        lines, gaps = [], []

    def close(last: bool) -> None:
        """Ends the conversation in hand."""
        nonlocal first
        flush()
        if not held and gap and begun:
            held.append([conv, shard, number, False, True, [], b"", None, None])
        if held:
            held[-1][4] = gap
            held[0][3] = len(held) == 1 and held[0][2] == start and not first and not last
        done.extend(held)
        held.clear()
        first = False

    for batch in batches:
        for c, text in zip(batch.column("conv_id").to_pylist(), batch.column("text")):
            if not begun or c != conv:
                if begun:
                    close(False)
                conv, gap, begun, start = c, False, True, number
            for line in (text.as_py() or "").split("\n"):
                if not line.strip():
                    gap = True
                    continue
                lines.append(line)
                gaps.append(gap)
                gap = False
                if len(lines) == SEGMENT:
                    flush()
            if len(held) > 64:  # surely not whole
                done.extend(held[:-1])
                del held[:-1]
        if len(done) >= 256:
            yield _batch(done, _SEGMENT)
            done = []
    if begun:
        close(True)
    if done:
        yield _batch(done, _SEGMENT)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Rows sorted by conversation, one conversation after another; each must be read to its end."""
    from itertools import groupby

    rows = (r for b in batches for r in b.to_pylist())
    yield from groupby(rows, key=lambda r: r["conv_id"])


_BORDER = "conv_id long, shard int, segment int, before int, ending int, gap boolean"


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains each conversation's bridges in order and traces the states at the borders back.

    Of a segment six back pointers stay in memory, whatever its length.
    """
    for c, rows in _conversations(batches):
        best, back, places, gap = None, [], [], False
        for x in rows:
            if x["bridge"] is None:  # blank lines only
                gap = True
                continue
            step = np.frombuffer(x["gapped"] if gap and x["gapped"] is not None else x["bridge"]).reshape(_STATES + 1, _STATES)
            if best is None:
                best = step[_STATES]
            else:
                total = best[:, None] + step[:_STATES]
                back.append(total.argmax(0).astype(np.int8))
                best = total.max(0)
            places.append((x["shard"], x["segment"], gap))
            gap = x["trail"]
        if best is None:
            continue
        ends = [int(best.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        out = [(c, h, k, ends[i - 1] if i else -1, end, g) for i, ((h, k, g), end) in enumerate(zip(places, ends))]
        for k in range(0, len(out), 8192):
            yield _batch(out[k : k + 8192], _BORDER)


_STATED = "conv_id long, shard int, segment int, whole boolean, lead int, starts int, tail int, lines array<string>, states binary"


def _stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decodes each segment: its lines' states, the lines before its first turn, its turns, and the lines of the last."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            gaps = [bool(g) for g in r["gaps"]]
            gaps[0] = gaps[0] or bool(r["gap"])
            states = viterbi(emissions(r["lines"], gaps), None if r["before"] is None or r["before"] < 0 else r["before"], r["ending"])
            first = np.flatnonzero(states < 3)
            n = len(states)
            lead, tail = (int(first[0]), n - int(first[-1])) if len(first) else (n, 0)
            out.append((r["conv_id"], r["shard"], r["segment"], r["whole"], lead, len(first), tail, r["lines"], states.astype(np.int8).tobytes()))
        yield _batch(out, _STATED)


_PLACE = "conv_id long, shard int, segment int, turn long, done long, after long"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment of a conversation in order: turns begun before it, lines of the open turn before it, and lines of its last turn after it."""
    for c, rows in _conversations(batches):
        found = [(r["shard"], r["segment"], r["lead"], r["starts"], r["tail"]) for r in rows]
        turn, done, before = 0, 0, []
        for _, _, lead, starts, tail in found:
            before.append((turn, done))
            turn += starts
            done = tail if starts else done + lead
        out, after = [], 0
        for (shard, segment, lead, starts, _), (turn, done) in zip(reversed(found), reversed(before)):
            out.append((c, shard, segment, turn, done, after))
            after = lead if starts else after + lead
        for k in range(0, len(out), 8192):
            yield _batch(out[k : k + 8192], _PLACE)


_PIECE = "conv_id long, turn long, piece long, at long, role string, bodies array<string>, n_lines long, last boolean, complete boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins each segment's lines into turns, cut after every PIECE lines of a turn."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            states = np.frombuffer(r["states"], np.int8)
            edges = np.flatnonzero(states < 3).tolist()
            n, turn = len(states), (r["turn"] or 0) - 1
            spans = ([(0, edges[0] if edges else n, True)] if not edges or edges[0] else []) + [(a, b, False) for a, b in zip(edges, [*edges[1:], n])]
            for a, b, goes_on in spans:
                if not goes_on:
                    turn += 1
                done = (r["done"] or 0) if goes_on else 0
                after = (r["after"] or 0) if b == n else 0
                at = a
                while at < b:
                    place = done + at - a
                    end = min(b, at + PIECE - place % PIECE)
                    bodies = []
                    for line, state in zip(r["lines"][at:end], states[at:end].tolist()):
                        said, cut_at = marker(line)
                        bodies.append((line[cut_at:] if said in (1, 2, 3) else line).strip())
                    last = end == b and not after
                    complete = place % PIECE == 0 and (last or (done + end - a) % PIECE == 0)
                    out.append((r["conv_id"], max(turn, 0), place // PIECE, place, ROLES[int(states[at]) % 3], bodies, end - at, last, complete))
                    at = end
        yield _batch(out, _PIECE)


def parse(transcripts: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Per turn: conv_id, turn (from 0), piece, role, text, n_lines and rendered (the canonical block).

    A transcript is all rows of one ``key`` by ``order``, then text, so rows
    that repeat or tie follow each other; each row holds one line or many. Rows
    without a key form one transcript; null and blank texts only part lines, and
    a transcript of such alone has no turn. Markers that name a role are
    removed, other lines kept whole. A turn of more than PIECE lines has a row
    for each PIECE of them (piece 1 and up go on where the one before stops);
    its block opens in the first and closes in the last. The rows do not depend
    on how the transcripts are dealt out: any range of (key, order, text) may be
    a task's, so a transcript of any size is spread over many. An empty table
    gives no rows. Only the three columns are read, so further columns cannot clash.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = transcripts.select(F.col(key).cast("long").alias("conv_id"), F.col(order).cast("long").alias("turn"), t.alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "text").sortWithinPartitions("conv_id", "turn", "text")
    segments = cut(dealt.select("conv_id", "text").mapInArrow(_segments, _SEGMENT))

    def in_order(part: DataFrame) -> DataFrame:
        return part.repartition("conv_id").sortWithinPartitions("conv_id", "shard", "segment")

    # What lies in one segment of one task needs no border.
    borders = in_order(segments.where("NOT whole").select("conv_id", "shard", "segment", "trail", "bridge", "gapped")).mapInArrow(_borders, _BORDER)
    held = segments.where("size(lines) > 0").select("conv_id", "shard", "segment", "whole", "lines", "gaps")
    stated = cut(held.join(borders.drop("conv_id"), ["shard", "segment"], "left").mapInArrow(_stated, _STATED))
    places = in_order(stated.where("NOT whole").select("conv_id", "shard", "segment", "lead", "starts", "tail")).mapInArrow(_places, _PLACE)
    pieces = cut(stated.join(places.drop("conv_id"), ["shard", "segment"], "left").select("conv_id", "lines", "states", "turn", "done", "after").mapInArrow(_pieces, _PIECE))
    # A piece that lies in several segments has at most PIECE lines in all.
    parts = pieces.where("NOT complete").groupBy("conv_id", "turn", "piece").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "bodies"))).alias("p"), F.sum("n_lines").alias("n_lines"), F.bool_or("last").alias("last")
    )
    joined = parts.select("conv_id", "turn", "piece", F.col("p")[0]["role"].alias("role"), F.flatten(F.transform("p", lambda x: x["bodies"])).alias("bodies"), "n_lines", "last")
    every = pieces.where("complete").select("conv_id", "turn", "piece", "role", "bodies", "n_lines", "last").unionByName(joined)
    body = F.array_join(F.filter("bodies", lambda b: b != ""), "\n")
    begin = F.when(F.col("piece") == 0, F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    end = F.when(F.col("last"), "\n<|end|>").otherwise("")
    return every.withColumn("text", body).select("conv_id", "turn", F.col("piece").cast("int").alias("piece"), "role", "text", "n_lines", F.concat(begin, "text", end).alias("rendered"))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Turns as raw transcripts have them: a speaker's name before most, none before each fourth (by hash), an empty line between."""
    names = F.create_map(*[F.lit(x) for r, n in zip(ROLES, ("System: ", "Human: ", "Assistant: ")) for x in (r, n)])
    lost = F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 4 == 0
    name = F.when(~lost & F.col("role").isin(*ROLES), F.element_at(names, F.col("role"))).otherwise("")
    return conversations.select("conv_id", "turn", F.concat(F.lit("\n"), name, F.coalesce("text", F.lit(""))).alias("text"))
