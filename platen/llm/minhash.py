"""Near copies by exact Jaccard similarity of word shingles, found through MinHash bands.

Each text has ``BANDS`` band keys of ``ROWS`` minima each. Two texts of
similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.99994 at
0.8. Every pair that shares a key is a candidate, and a candidate is a link
only if the shingle sets themselves are similar enough, so a group's links are
never estimates.

Keys of at most ``HOT`` members yield all their pairs. A larger key's members are
first held against one of them; those that this leaves in several components are
then compared in one place, each with every member outside its own component,
so that no pair of unlike components stays unseen and only links leave the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bit_filter, chunks, components, cut, few, in_filter, lean, mix, rolled, utf8

SIMILARITY = 0.8
ROWS, BANDS = 6, 32
BASE = 0x51ED270B
#: Members of a key beyond which its pairs are not all made as rows.
HOT = 64

_rng = np.random.default_rng(20240607)
_FLIP = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_FOLD = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words and each document's edges; a shorter text is one run, no word none."""
    data = np.frombuffer(data.tobytes().lower(), np.uint8)
    words = Words(data, offsets)
    n = words.count
    edges = np.concatenate([[0], np.cumsum(np.where(n >= length, n - length + 1, np.minimum(n, 1)))])
    out = np.zeros(edges[-1], np.uint64)
    if len(at := words.windows(length)):
        out[np.repeat(n >= length, np.diff(edges))] = rolled(words.hash, length, BASE)[at]
    for few_words in range(1, length):
        if len(short := np.flatnonzero(n == few_words)):
            out[edges[short]] = rolled(words.hash, few_words, BASE)[words.first[short]]
    return out, edges


def band_keys(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Documents x BANDS keys; documents without a shingle share all of theirs."""
    out = np.zeros((len(edges) - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(edges))
    g = (hashes >> np.uint64(32)).astype(np.uint32)
    turned = np.empty_like(g)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.zeros(len(some), np.uint64)
            for row in range(ROWS if len(some) else 0):
                np.bitwise_xor(g, _FLIP[band * ROWS + row], out=turned)
                np.multiply(turned, _TIMES[band * ROWS + row], out=turned)
                key += np.minimum.reduceat(turned, edges[:-1][some]).astype(np.uint64) * _FOLD[row]
            out[some, band] = key
            out[:, band] = mix(out[:, band] + np.uint64(band + 1))
    return out


def _pieces(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    for a, b in chunks(offsets):
        yield a, b, *shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)


def bands(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (key, id): the band keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, b, hashes, edges in _pieces(batch, shingle):
                keys = band_keys(hashes, edges).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids[a:b], BANDS))], names=["key", "id"])

    return texts.mapInArrow(lean(run), "key long, id long")


def shingle_sets(texts: DataFrame, ids: DataFrame, n: int, shingle: int) -> DataFrame:
    """Rows (id, grams): the sorted distinct shingle hashes of the texts that ``ids`` names, and a few more."""
    asked = in_filter("id", bit_filter(ids, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in asked(batches):
            for a, b, hashes, edges in _pieces(batch, shingle):
                grams = [np.unique(hashes[i:j]).tobytes() for i, j in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(grams, pa.binary())], names=["id", "grams"])

    return texts.mapInArrow(lean(run), "id long, grams binary").groupBy("id").agg(F.first("grams").alias("grams"))


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of hashes; of two empty ones 1."""
    if not a or not b:
        return float(a == b)
    both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            # Sets whose sizes alone rule the pair out need no look.
            near = [min(len(p), len(q)) >= least * max(len(p), len(q)) and similarity(p, q) >= least for p, q in ((x[i].as_py(), y[i].as_py()) for i in range(len(x)))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def joined(grams: list[bytes], roots: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (indices) that join the components ``roots`` of one key's members as all their similar pairs do."""
    label = roots.copy()
    values, place = np.unique(np.concatenate([np.frombuffer(g, np.uint64) for g in grams]), return_inverse=True)
    n = np.array([len(g) // 8 for g in grams])
    edges = np.concatenate([[0], np.cumsum(n)])
    known, sizes = np.unique(label, return_counts=True)
    most = known[sizes.argmax()]
    some = np.flatnonzero(n)
    mark = np.zeros(len(values), np.int64)
    links = []
    for q in np.flatnonzero(roots != most):
        if label[q] == most:
            continue
        own = place[edges[q] : edges[q + 1]]
        mark[own] = 1
        common = np.zeros(len(grams), np.int64)
        common[some] = np.add.reduceat(mark[place], edges[:-1][some])
        mark[own] = 0
        whole = n + n[q] - common
        near = np.where(whole == 0, True, common / np.maximum(whole, 1) >= least)
        while len(other := np.flatnonzero(near & (label != label[q]))):
            links.append((int(q), int(other[0])))
            to, old = label[other[0]], label[q]
            label[label == (old if to == most else to)] = most if to == most else old
    return links


def hot_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among the roots of each key's ``members`` (key, id, root)."""
    ordered = members.join(sets, "id").select("key", "root", "grams").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[list]) -> pa.RecordBatch:
            roots = np.array([r[0] for r in rows], np.int64)
            at = np.array(joined([r[1] for r in rows], roots, least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(roots[at[:, 0]]), pa.array(roots[at[:, 1]])], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and k != key:
                    yield found(held)
                    held = []
                key = k
                held.append(row)
        if held:
            yield found(held)

    return ordered.mapInArrow(lean(run), "a long, b long")


def groups(texts: DataFrame, shingle: int = 5, least: float = SIMILARITY, hot: int = HOT, besides: DataFrame | None = None) -> DataFrame:
    """Rows (node, root): components of the texts (id long, text) with links of at least that similarity.

    Rows of equal id have equal texts. Only ids that share a key are returned.
    besides: further candidates, rows (key, id); they are compared like those of a band.
    """
    keyed = bands(texts, shingle)
    keyed = cut((keyed if besides is None else keyed.unionByName(besides)).distinct())
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("m")).where("n > 1")
    members = cut(keyed.join(shared.select("key", "n", F.col("m.id").alias("first")), "key"))
    ids = members.select("id").distinct()
    sets = cut(shingle_sets(texts, ids, ids.count(), shingle))
    cold = members.where(F.col("n") <= hot).select("key", "id")
    pairs = cold.join(cold.withColumnRenamed("id", "first"), "key").where("id < first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    stars = members.where((F.col("n") > hot) & (F.col("id") != F.col("first"))).select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
    root = components(verified(pairs.union(stars).distinct(), sets, least))
    named = ids.join(root.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    rooted = members.where(F.col("n") > hot).select("key", "id").join(named, "id")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    more = components(hot_links(rooted.join(mixed, "key"), sets, least))
    return named.join(more.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("to", "root").alias("root"))
