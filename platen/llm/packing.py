"""Best-fit packing of tokenised documents into sequences of at most CAPACITY tokens.

Only lengths decide a packing, and there are at most CAPACITY of them, so the
plan is made from a histogram (bounded, whatever the corpus): pieces above one
third of the capacity are matched greedily, the longest with the longest that
still fits, at most two to a sequence; shorter ones go, longest first, into
the smallest gap that takes them. The plan gives each length a row of slots;
a piece takes the slot of its rank among the pieces of its length, ranks being
counted by partition and summed. The plan is global: no shard packs alone.
"""

from __future__ import annotations

import binascii
import sys
import types
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batches_of, chunks, cut, lean, tight, utf8

CAPACITY = 4096
END = 1
#: Distinct pieces whose ids a worker keeps (about 50 bytes each).
KEPT_WORDS = 3 << 19
#: Documents that a worker is sent at once: their texts lie in both processes, for each core.
BATCH = 2000


class Pieces(Words):
    """Words cut further where the tokenizer cuts anyway: between ASCII letters and other ASCII.

    Words that hold an apostrophe (contractions) or the start of a special
    token stay whole. Capitals are lowered in words that are ASCII throughout.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, hashed=False)
        self.offsets = offsets
        if len(self.start):
            high = data >= 128
            lower = data | 32
            letter = (lower >= ord("a")) & (lower <= ord("z")) & ~high
            special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
            foreign, whole = self._with(np.flatnonzero(high)), self._with(special)
            capital = np.flatnonzero(letter & (data < ord("a")))
            capital = capital[~(foreign | whole)[self._word(capital)]]
            self.data = data.copy()
            self.data[capital] |= 32
            whole |= self._with(np.flatnonzero(data == ord("'")))
            solid = data > 32
            at = np.flatnonzero((letter[1:] != letter[:-1]) & solid[1:] & solid[:-1] & ~high[1:] & ~high[:-1]) + 1
            word = self._word(at)
            at = at[~whole[word] & (at > self.start[word])]
            self.start = np.sort(np.concatenate([self.start, at]))
            self.end = np.sort(np.concatenate([self.end, at]))
            self.first = np.searchsorted(self.start, offsets)
            self.count = np.diff(self.first)
        self.hash = self.hashes()

    def _word(self, at: np.ndarray) -> np.ndarray:
        """The word that each byte position lies in."""
        return np.searchsorted(self.start, at, "right") - 1

    def _with(self, at: np.ndarray) -> np.ndarray:
        """Which words hold one of these positions."""
        found = np.zeros(len(self.start), bool)
        found[self._word(at)] = True
        return found


class WordTokenizer:
    """Ids by a tokenizer that never joins text across white space, piece by piece.

    Pieces are looked up by a 64-bit hash of their bytes among those met
    before, and their bytes are compared with what was met; new ones are given
    to the tokenizer, many to a call, with a control character between them
    whose id no other text has. Should a piece not be the one met, the
    tokenizer reads the whole documents.
    """

    BREAK = b"\x01"
    GROUP = 50

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.encode(self.BREAK.decode(), add_special_tokens=False).ids
        assert len(self.between) == 1
        self._clear()

    @staticmethod
    def kept(path: str) -> WordTokenizer:
        """The one of this Python worker: what it has learnt serves the worker's later tasks too."""
        holder = sys.modules.setdefault("_platen_worker", types.ModuleType("_platen_worker"))
        known = holder.__dict__.setdefault("tokenizers", {})
        if path not in known:
            tight()
            known[path] = WordTokenizer(path)
        return known[path]

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.raw = np.zeros(0, np.uint8)
        self.begin = np.zeros(0, np.int64)
        self.width = np.zeros(0, np.int64)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids in a row, and how many each has."""
        odd = [i for i, p in enumerate(pieces) if self.BREAK in p]
        alone = {i: self.tokenizer.encode(pieces[i].decode("utf-8", "replace"), add_special_tokens=False).ids for i in odd}
        for i in odd:
            pieces[i] = b""
        glue = b" " + self.BREAK + b" "
        groups = [glue.join(pieces[i : i + self.GROUP]).decode("utf-8", "replace") for i in range(0, len(pieces), self.GROUP)]
        flat: list[int] = []
        for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
            flat += e.ids
            flat += self.between
        ids = np.array(flat, np.uint32)
        ends = np.flatnonzero(ids == self.between[0])
        size = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.between[0]]
        if alone:
            parts = np.split(ids, np.cumsum(size)[:-1])
            for i, found in alone.items():
                parts[i], size[i] = np.array(found, np.uint32), len(found)
            ids = np.concatenate(parts)
        return ids, size

    def _learn(self, words: Words, keys: np.ndarray, first: np.ndarray) -> None:
        if len(self.keys) > KEPT_WORDS:
            self._clear()
            keys, first = np.unique(words.hash, return_index=True)
        raw = words.data.tobytes()
        ids, size = self._encoded([raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())])
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        width = words.end[first] - words.start[first]
        begin = len(self.raw) + np.cumsum(width) - width
        self.raw = np.concatenate([self.raw, words.data[_places(words.start[first], width)]])
        place = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("at", at), ("size", size), ("begin", begin), ("width", width)):
            setattr(self, name, np.insert(getattr(self, name), place, new))

    def _met(self, words: Words, place: np.ndarray) -> bool:
        """Whether every word's bytes are those of the piece at its place."""
        width = words.end - words.start
        if (self.width[place] != width).any():
            return False
        return bool((self.raw[_places(self.begin[place], width)] == words.data[_places(words.start, width)]).all())

    def _whole(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The documents' ids by the tokenizer alone."""
        raw = words.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())]
        found = [np.array([*e.ids, END], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids, each followed by END, and the documents' lengths."""
        keys, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            self._learn(words, keys[~known], first[~known])
            place = np.searchsorted(self.keys, keys)
        place = place[back]
        if not self._met(words, place):
            return self._whole(words)
        at, size = self.at[place], self.size[place]
        total = np.concatenate([[0], np.cumsum(size)])
        lengths = total[words.first[1:]] - total[words.first[:-1]] + 1
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint32)
        source = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        out[np.arange(total[-1]) + np.repeat(words.doc(), size)] = self.ids[source]
        return out, lengths


def _places(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The positions start, start + 1 ... of each run of ``width``, one run after another."""
    total = np.cumsum(width)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - width), width)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, rank long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows of pieces; rank: a piece's number among those of its length in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encoder = WordTokenizer.kept(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                ids, lengths = encoder.encode(Pieces(data[part[0] : part[-1]], part - part[0]))
                n = -(-lengths // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, lengths[doc] - start)
                begin = (np.cumsum(lengths) - lengths)[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [binascii.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), (begin + length).tolist())]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + seen[ranked]
                np.add.at(seen, length, 1)
                columns = [
                    batch.column("doc_id").take(pa.array(doc + a)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), shard)),
                    pa.array(rank),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "rank"]
                if with_ids:
                    columns.append(pa.array([ids[x:y] for x, y in zip(begin.tolist(), (begin + length).tolist())], pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), _PIECE + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) for so many pieces of each length.

    Sequences of like content are handled together, as (content, how many).
    """
    left = {size: n for size, n in histogram.items() if n}
    large = sorted(size for size in left if 3 * size > capacity)
    kinds: list[tuple[list[int], int]] = []
    i, j = len(large) - 1, 0
    # Greedy matching: the longest takes the longest partner that fits.
    while i >= 0:
        size = large[i]
        while left[size]:
            partner = capacity - size
            k = bisect_left(large, partner + 1) - 1
            while k >= 0 and not left[large[k]]:
                k -= 1
            if k < 0:
                kinds.append(([size], left[size]))
                left[size] = 0
            elif large[k] == size:
                pairs = left[size] // 2
                if pairs:
                    kinds.append(([size, size], pairs))
                    left[size] -= 2 * pairs
                if left[size]:
                    left[size] = 0
                    k -= 1
                    while k >= 0 and not left[large[k]]:
                        k -= 1
                    if k >= 0:
                        left[large[k]] -= 1
                        kinds.append(([size, large[k]], 1))
                    else:
                        kinds.append(([size], 1))
            else:
                n = min(left[size], left[large[k]])
                kinds.append(([size, large[k]], n))
                left[size] -= n
                left[large[k]] -= n
        i -= 1
    # Best fit: by gap, the kinds of sequences that have it.
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    open_gaps: list[int] = []

    def leave(content: list[int], n: int) -> None:
        gap = capacity - sum(content)
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((content, n))

    for content, n in kinds:
        leave(content, n)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        count = left[size]
        while count:
            k = bisect_left(open_gaps, size)
            if k == len(open_gaps):
                fill = capacity // size
                whole, rest = divmod(count, fill)
                if whole:
                    leave([size] * fill, whole)
                if rest:
                    leave([size] * rest, 1)
                count = 0
                continue
            gap = open_gaps[k]
            content, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(k)
            # Into one sequence the size may go several times, as it would while its gap stays the smallest.
            fits = gap // size
            whole, rest = divmod(count, fits)
            used = min(n, whole)
            if used:
                leave(content + [size] * fits, used)
                count -= used * fits
            if used < n and count:
                leave(content + [size] * min(count, fits), 1)
                count -= min(count, fits)
                used += 1
            if used < n:
                leave(content, n - used)
    slots, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for gap in sorted(gaps):
        for content, n in gaps[gap]:
            offset = 0
            for size in content:
                slots.append((size, rank[size], n, sequence, offset))
                rank[size] += n
                offset += size
            sequence += n
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset (ids too, if asked for).

    A null or empty text is a document of the end id alone. Only doc_id and the
    text are read, so further columns cannot clash; rows that repeat are packed
    each for itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # Written once: ranks must not change when a task is run again.
    with batches_of(spark, BATCH):
        made = cut(pieces(docs, tokenizer, capacity, text, with_ids))
    by_shard = made.groupBy("length", "shard").count()
    before = by_shard.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("shard")) - F.col("count")).drop("count")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(slots)
    ranked = made.join(before, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "shard")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        step = np.int64(1) << 40
        keys = slots[:, 0] * step + slots[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * step + rank, "right") - 1
            out = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            out["sequence_id"] = pa.array(slots[k, 3] + rank - slots[k, 1])
            out["offset"] = pa.array(slots[k, 4])
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return ranked.mapInArrow(lean(seat), schema)


def texts_of(packed: DataFrame) -> DataFrame:
    """Sequences as arrays of ids, from a packing made with_ids: rows (sequence_id, ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.getField("ids"))).alias("ids"))
