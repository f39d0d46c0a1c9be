"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are one- and two-word grams of the words and of their shapes (runs of
lower case, capitals, digits, each other character as it is), hashed into
2**BITS columns, and one column for three-word grams the text has had before.
A feature's value is its share of the text's grams of its kind, so a score is
a sparse dot product: a mean of weights over the grams of each kind.

The model is fitted on a bounded sample of labelled rows (``sample``, the ones
of least hashed id), whatever the corpus; every row is scored by its whole
text. Labels, ids, sources and languages are no inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, lean, mix, rolled, utf8

BITS = 18
SAMPLE = 6000
FOLDS = 5
THRESHOLD = 0.3
#: Kinds of grams: words 1, words 2, shapes 1, shapes 2, repeated words 3, length.
KINDS = 6
#: How much each kind counts.
SCALE = np.array([4.0, 4.0, 8.0, 8.0, 8.0, 2.0])

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def _shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    kind = _CLASS[words.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.start] = True
    inside = np.zeros(len(kind) + 1, np.int64)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    new &= np.cumsum(inside[:-1]) > 0
    at = np.flatnonzero(new)
    first = np.searchsorted(at, words.start)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return mix(np.add.reduceat(mix(kind[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), first))


def grams(words: Words, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, document of each gram, column of each gram), kind by kind."""
    doc = words.doc()
    shapes = _shapes(words)
    for kind, hashes, length in ((0, words.hash, 1), (1, words.hash, 2), (2, shapes, 1), (3, shapes, 2)):
        starts = words.windows(length)
        keys = rolled(hashes, length, 0x632BE59B)[starts] if len(starts) else np.zeros(0, np.uint64)
        yield kind, doc[starts], (mix(keys + np.uint64(kind)) >> np.uint64(64 - bits)).astype(np.int64)
    starts = words.windows(3)
    keys = rolled(words.hash, 3, 0x632BE59B)[starts] if len(starts) else np.zeros(0, np.uint64)
    keys = keys + mix(doc[starts].astype(np.uint64))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    yield 4, doc[starts], np.where(again, 0, 1)
    # One gram of length: the number of words, by powers of two.
    size = np.frexp(words.count.astype(float))[1]
    yield 5, np.arange(len(words.count)), 2 + np.minimum(size, 40)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, words: Words, bits: int = BITS) -> np.ndarray:
        total = np.full(len(words.count), self.bias)
        for kind, doc, column in grams(words, bits):
            sums = np.bincount(doc, self.weights[column], minlength=len(total))
            total += SCALE[kind] * sums / np.maximum(np.bincount(doc, minlength=len(total)), 1)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def sparse(words: Words, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, values) of each document."""
    docs, columns, values = [], [], []
    for kind, doc, column in grams(words, bits):
        share = SCALE[kind] / np.maximum(np.bincount(doc, minlength=len(words.count)), 1)
        docs.append(doc)
        columns.append(column)
        values.append(share[doc])
    doc, column, value = map(np.concatenate, (docs, columns, values))
    keys, back = np.unique(doc << bits | column, return_inverse=True)
    total = np.bincount(back, value, minlength=len(keys))
    edge = np.searchsorted(keys >> bits, np.arange(len(words.count) + 1))
    column = (keys & ((1 << bits) - 1)).astype(np.int32)
    return [(column[a:b], total[a:b].astype(np.float32)) for a, b in zip(edge, edge[1:])]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """FTRL-proximal, one row at a time; without any row every score is one half."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    w = np.zeros(1 << bits)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for column, value, y in rows:
            margin = bias + float(value @ w[column])
            error = 1 / (1 + np.exp(-min(max(margin, -35.0), 35.0))) - y
            g = error * value
            old = n[column]
            new = old + g * g
            z[column] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w[column]
            n[column] = new
            zc = z[column]
            w[column] = np.where(np.abs(zc) <= l1, 0.0, -(zc - np.sign(zc) * l1) / ((beta + np.sqrt(new)) / alpha + l2))
            grown = nb + error * error
            zb += error - (grown**0.5 - nb**0.5) / alpha * bias
            nb = grown
            bias = -zb / ((beta + nb**0.5) / alpha)
    return Model(w.astype(np.float32), bias)


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def sample_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text") -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of at most ``sample`` rows outside fold 0, in a fixed order."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most ``sample`` ids are broadcast.
    joined = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                found = sparse(Words(data[part[0] : part[-1]], part - part[0]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("label").slice(a, b - a),
                        pa.array([c.tobytes() for c, _ in found], pa.binary()),
                        pa.array([v.tobytes() for _, v in found], pa.binary()),
                    ],
                    names=["doc_id", "label", "columns", "values"],
                )

    made = joined.mapInArrow(lean(run), "doc_id long, label int, columns binary, values binary")
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "columns", "values").limit(sample).collect()
    return [(np.frombuffer(r["columns"], np.int32), np.frombuffer(r["values"], np.float32), r["label"]) for r in got]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and score (of label 1), by the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 4 * 2**BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [np.zeros(0)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                found.append(Model(*shared.value).scores(Words(data[part[0] : part[-1]], part - part[0])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out (its fold is 0), score and predicted.

    A null text counts as empty; an empty one is scored by its length alone.
    Labels that are null or neither 0 nor 1 are not learnt from; without
    labels every score is one half. Labels that disagree for one id are all
    learnt from, and rows that repeat an id all count. Equal texts get equal
    scores, whatever their rows; a text is scored whole, however long, in memory
    of some hundred bytes a word of it. An empty table gives no rows. A null doc_id is never held out. Only
    doc_id, the text and the label are read, so further columns cannot clash.
    """
    model = fit(sample_rows(docs, labels, label, sample, text))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return score(docs, model, text).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
