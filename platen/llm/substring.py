"""Substring deduplication: a count-min prefilter, then exact grouping.

A window is ``WINDOW`` consecutive words of one document. Every word under a
window that also starts anywhere else is removed.

0. Equal texts are one class. All windows of a class of several rows repeat, so
   nothing but its word count has to be found out; everything below reads each
   different text once.
1. Each window is hashed through its anchor: of the 8-word runs inside it, the
   one of least hash. Equal windows have equal anchors at equal places, so two
   starts of a window hold two occurrences of its anchor: the count of anchors
   is never below the count of the window. The sketch has one block of
   ``DEPTH`` rows for so many bytes of text (``BYTES_PER_BLOCK``), so it grows
   with the corpus and stays as selective; it is never in one place. A task's
   part of a block (its anchors, those that repeat within the task only once)
   goes to the block's owner, which adds the parts up, saturating at two, and
   answers with the anchors whose cells all say "two or more".
2. Windows of such anchors are grouped exactly, by a 96-bit key from two
   independent hashes of each word. No repeated window can be missed: the
   sketch only overestimates.

Equal windows among some hundred thousand are counted before they are shuffled,
so a passage that a third of all rows share costs a row a group, not a row a
copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, back_to_rows, chunks, cut, first_seen, lean, mix, rolled, sliding, utf8

WINDOW = 35
GRAM = 8
DEPTH = 2
#: Cells of a block's row (log 2), and the bytes of text a block is made for: some 4,000 anchors.
CELLS = 16
BYTES_PER_BLOCK = 1 << 18

_ROW = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SPAN = WINDOW - GRAM + 1
_FLUSH = 1 << 20
#: Windows estimated repeated that a task groups before it sends them on.
GROUPED = 1 << 17


def _cells(anchors: np.ndarray, row: int) -> np.ndarray:
    """Each anchor's cell in a row of its block."""
    return ((anchors * _ROW[row]) >> np.uint64(64 - CELLS)).astype(np.int64)


def _blocks(anchors: np.ndarray, n: int) -> np.ndarray:
    """Each anchor's block."""
    return ((anchors >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, Words]]:
    """The words of each chunk of a batch, with the chunk's first row."""
    data, offsets = utf8(batch.column(column))
    for first, last in chunks(offsets):
        part = offsets[first : last + 1]
        yield first, Words(data[part[0] : part[-1]], part - part[0])


def _window_anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the anchor of each, and the 8-word keys at each place."""
    starts = words.windows(WINDOW)
    grams = rolled(words.hash, GRAM, 0x51ED270B) if len(starts) else np.zeros(0, np.uint64)
    return starts, sliding(grams, _SPAN, np.minimum)[starts], grams


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The anchor keys of all windows, one for each place that is some window's anchor, and these places."""
    starts, least, grams = _window_anchors(words)
    if not len(starts):
        return grams[:0], starts
    low = np.zeros(len(grams), np.uint64)
    low[starts] = least
    padded = np.concatenate([np.zeros(_SPAN - 1, np.uint64), low])
    at = np.flatnonzero(sliding(padded, _SPAN, np.maximum) == grams)
    return grams[at], at


_PART = "part long, block long, h1 long, h2 long, anchor long, times int"


def _parts(n: int):
    """A task's parts of the sketch: rows of anchors by block.

    times 1: the only one of its anchor among some million; 2, no text: the
    anchor repeats there; 2 and a text: that text holds a repeated anchor, which
    is certain already and goes to the text at once (block -1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            anchor, h1, h2 = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(anchor, kind="stable")
            ranked = anchor[order]
            heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            counts = np.diff(np.append(heads, len(order)))
            single, several = order[heads[counts == 1]], order[heads[counts > 1]]
            sure = np.ones(len(anchor), bool)
            sure[single] = False
            sure = np.flatnonzero(sure)
            at = np.concatenate([single, several, sure])
            placed = np.repeat([True, False, True], [len(single), len(several), len(sure)])
            block = _blocks(anchor[at], n)
            block[len(single) + len(several) :] = -1
            times = np.repeat(np.array([1, 2, 2], np.int32), [len(single), len(several), len(sure)])
            part = np.where(block >= 0, block, h1[at])
            return pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(block), pa.array(h1[at], mask=~placed), pa.array(h2[at], mask=~placed), pa.array(anchor[at].view(np.int64)), pa.array(times)],
                names=[f.split()[0] for f in _PART.split(", ")],
            )

        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for first, words in _texts(batch, "text"):
                found, at = _anchors(words)
                row = np.searchsorted(words.first, at, "right") - 1 + first
                held.append((found, h1[row], h2[row]))
                if sum(len(h[0]) for h in held) >= _FLUSH:
                    yield flush()
        if sum(len(h[0]) for h in held):
            yield flush()

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the parts of each block up; yields the placed anchors whose estimated count is two or more."""
    held: list[tuple[np.ndarray, ...]] = []
    block = None

    def done() -> Iterator[pa.RecordBatch]:
        anchor, times, placed, h1, h2 = map(np.concatenate, zip(*held))
        held.clear()
        again = np.ones(len(anchor), bool)
        if block >= 0:
            for row in range(DEPTH):
                cells = _cells(anchor, row)
                again &= np.bincount(cells, times, minlength=1 << CELLS)[cells] >= 2
        again &= placed
        if again.any():
            yield pa.RecordBatch.from_arrays([pa.array(h1[again]), pa.array(h2[again]), pa.array(anchor[again].view(np.int64))], names=["h1", "h2", "anchor"])

    for batch in batches:
        if not batch.num_rows:
            continue
        placed = np.asarray(batch.column("h1").is_valid())
        h1, h2 = (batch.column(c).fill_null(0).to_numpy() for c in ("h1", "h2"))
        blocks = batch.column("block").to_numpy()
        row = (batch.column("anchor").to_numpy().view(np.uint64), batch.column("times").to_numpy(), placed, h1, h2)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
        for a, b in zip(edges, edges[1:]):
            if held and (blocks[a] != block or block < 0):
                yield from done()
            block = blocks[a]
            held.append(tuple(c[a:b] for c in row))
    if held:
        yield from done()


def suspects(texts: DataFrame, n_bytes: int) -> DataFrame:
    """Rows (h1, h2, anchors): each text's anchors whose estimated count is two or more, as packed longs."""
    n = max(1, -(-n_bytes // BYTES_PER_BLOCK))
    parts = texts.select("h1", "h2", "text").mapInArrow(lean(_parts(n)), _PART)
    owned = parts.repartition("part").sortWithinPartitions("block")
    found = owned.mapInArrow(lean(_answers), "h1 long, h2 long, anchor long")
    return found.groupBy("h1", "h2").agg(F.collect_set("anchor").alias("anchors"))


_POSTING = "k1 long, k2 int, h1 long, h2 long, place int, length int"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows estimated repeated, grouped some hundred thousand at a time.

    length 0: the only start of the window in its group; no place: the window
    starts repeatedly there (sent to tell other groups); else a run of such
    starts, certain already. A class of several rows sends no place.
    """
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        h1, h2, several = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("copies").to_numpy() > 1
        lists = batch.column("anchors")
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.array([len(v) for v in lists], np.int64))])
        for first, words in _texts(batch, "text"):
            starts, least, _ = _window_anchors(words)
            doc = np.searchsorted(words.first, starts, "right") - 1
            # An anchor counts in the texts that it was found in.
            asked = np.sort(mix(flat[ends[first] : ends[first + len(words.count)]]) + np.repeat(np.arange(len(words.count)), np.diff(ends[first : first + len(words.count) + 1])).astype(np.uint64))
            mine = mix(least) + doc.astype(np.uint64)
            place = np.searchsorted(asked, mine)
            hit = np.zeros(len(starts), bool)
            inside = place < len(asked)
            hit[inside] = asked[place[inside]] == mine[inside]
            starts, doc = starts[hit], doc[hit]
            if len(starts):
                k1 = rolled(words.hash, WINDOW, 0x2545F491)[starts]
                k2 = (rolled(words.hashes(1), WINDOW, 0x369DEA0F)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row = doc + first
                held.append((k1, k2, h1[row], h2[row], several[row], starts - words.first[doc]))
            if sum(len(h[0]) for h in held) >= GROUPED:
                yield _grouped(held)
                held = []
    if held:
        yield _grouped(held)


def _grouped(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    k1, k2, h1, h2, copied, place = map(np.concatenate, zip(*held))
    order = np.lexsort((k2, k1))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    heads = np.flatnonzero(fresh)
    counts = np.diff(np.append(heads, len(order)))
    head = order[heads]
    alone = (counts == 1) & ~copied[head]
    single, several = np.sort(head[alone]), head[~alone]
    sure = ~copied
    sure[single] = False
    sure = np.flatnonzero(sure)  # in order of text and place
    edge = np.ones(len(sure), bool)
    edge[1:] = (h1[sure][1:] != h1[sure][:-1]) | (h2[sure][1:] != h2[sure][:-1]) | (place[sure][1:] != place[sure][:-1] + 1)
    begin = np.flatnonzero(edge)
    length = np.diff(np.append(begin, len(sure)))
    begin = sure[begin]
    at = np.concatenate([single, several, begin])
    unplaced = np.repeat([False, True, False], [len(single), len(several), len(begin)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(k1[at].view(np.int64)),
            pa.array(k2[at]),
            pa.array(h1[at], mask=unplaced),
            pa.array(h2[at], mask=unplaced),
            pa.array(place[at].astype(np.int32), mask=unplaced),
            pa.array(np.concatenate([np.zeros(len(single) + len(several), np.int32), length.astype(np.int32)])),
        ],
        names=["k1", "k2", "h1", "h2", "place", "length"],
    )


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the counts, and the kept words joined by one space."""
    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        n_words, n_removed, kept = [], [], []
        for text, copies, runs in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("runs")):
            words = text.as_py().encode().split()
            n_words.append(len(words))
            if copies > 1 and len(words) >= WINDOW:
                words = []
            elif runs.is_valid and len(runs.values):
                packed = runs.values.to_numpy()
                at, size = packed >> 32, packed & 0xFFFFFFFF
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.minimum(at + size + WINDOW - 1, len(words)), -1)
                stays = np.cumsum(edge[:-1]) == 0
                words = [words[j] for j in np.flatnonzero(stays)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("h1"), batch.column("h2"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["h1", "h2", "n_words", "n_removed", "kept_text"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _removal(batches):
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in found.column("kept_text")]
        yield pa.RecordBatch.from_arrays([*found.columns[:4], pa.array(sums, pa.string())], names=["h1", "h2", "n_words", "n_removed", "kept_sha256"])


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2"), t.alias("text"))


def classes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, int, int]:
    """(one row per different text with its number of rows, those numbers, all rows' count and bytes).

    A text may come twice, from two tasks, if it has several rows: its number says so.
    """
    keyed = _keyed(docs, text)
    counted = cut(keyed.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first(F.octet_length("text")).alias("bytes")))
    rows, size = counted.agg(F.sum("copies"), F.sum(F.col("bytes").cast("long"))).first()
    own = keyed.select("h1", "h2", "text").mapInArrow(lean(first_seen("h1", "h2")), "h1 long, h2 long, text string")
    # The counts are far smaller than the texts: hashing them spares the texts a sort.
    texts = own.join(counted.select("h1", "h2", "copies").hint("SHUFFLE_HASH"), ["h1", "h2"])
    return texts, counted, rows or 0, size or 0


def repeated_windows(texts: DataFrame, n_bytes: int) -> DataFrame:
    """Rows (h1, h2, place, length): runs of starts of repeated windows of the texts that have one row, by word position."""
    asked = suspects(texts, n_bytes).hint("SHUFFLE_HASH")
    rows = texts.join(asked, ["h1", "h2"]).select("h1", "h2", "copies", "anchors", "text").mapInArrow(lean(_postings), _POSTING)
    # A run needs no partner: runs are dealt out by text.
    run = F.col("length") > 0
    key1 = F.when(run, F.xxhash64("h1", "h2", "place")).otherwise(F.col("k1"))
    key2 = F.when(~run, F.col("k2"))
    starts = F.when(run, 0).when(F.col("place").isNull(), 2).otherwise(1)
    keyed = rows.withColumns({"k1": key1, "k2": key2})
    total = F.sum(starts).over(Window.partitionBy("k1", "k2"))
    found = keyed.withColumn("total", total).where(run | (F.col("place").isNotNull() & (F.col("total") > 1)))
    return found.select("h1", "h2", "place", F.greatest("length", F.lit(1)).alias("length"))


def _judged(docs: DataFrame, text: str, run, result: str) -> DataFrame:
    """Per row of ``docs``: doc_id and what ``run`` makes of its class."""
    texts, counted, n, size = classes(docs, text)
    packed = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    runs = repeated_windows(texts, size).groupBy("h1", "h2").agg(F.collect_list(packed).alias("runs")).hint("SHUFFLE_HASH")
    made = texts.join(runs, ["h1", "h2"], "left").select("h1", "h2", "copies", "text", "runs").mapInArrow(lean(run), f"h1 long, h2 long, {result}").dropDuplicates(["h1", "h2"])
    heavy = counted.where(F.col("copies") > max(1000, n // 1000)).select("h1", "h2")
    return back_to_rows(_keyed(docs, text).select("doc_id", "h1", "h2"), made, ["h1", "h2"], heavy).drop("h1", "h2")


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and kept_text (kept words joined by one space).

    A null or empty text has no words and an empty kept_text. Equal rows, and
    rows without a doc_id, are judged like any others. Only doc_id and the
    text are read, so further columns cannot clash. An empty table gives none.
    """
    return _judged(docs, text, _removal, "n_words long, n_removed long, kept_text string")


def dedup_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """As dedup(), with the SHA-256 of the kept text's UTF-8 instead of the text."""
    return _judged(docs, text, _digests, "n_words long, n_removed long, kept_sha256 string")
