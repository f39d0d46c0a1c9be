"""SimHash near-duplicates: fingerprints linked through sharded BK-trees.

Fingerprints within ``radius`` bits of each other are linked and components of
links form groups. Two such fingerprints, cut into ``blocks`` blocks, agree in
at least ``blocks - radius`` whole blocks; so each combination of that many
blocks deals the fingerprints into shards by their value there, and every link
lies inside some shard. A shard's fingerprints are indexed by a BK-tree
(children keyed by their Hamming distance to the parent); a search follows
only the edges within the radius of its own distance.

Up to ``BROADCAST`` distinct fingerprints (counted first), they are broadcast
once and a task is a list of shards: it builds each shard's tree from them and
searches it, and nothing but shard numbers is shuffled. Beyond, the whole set of
trees has no size that could be broadcast safely, so fingerprints are dealt to
their shards instead; trees, searches and links are the same. Equal fingerprints
are one node; a shard that still holds many is dealt again by its remaining
bits. A shard yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import Forest, back_to_rows, components, cut, few, lean, utf8

SEED = 42
RADIUS = 4
#: The radius of candidates that are then compared exactly.
WIDE = 8
#: Fingerprints in a shard beyond which it is dealt again.
HOT_SHARD = 20_000
#: Distinct fingerprints that are broadcast at most: 16 MB.
BROADCAST = 1 << 21
#: Fingerprints that a shard holds on average at least, so that few trees are built, and at most.
SMALL_SHARD, LARGE_SHARD = 256, 4096


def fingerprint_of(words: list[bytes], shingle: int) -> int:
    """The 64-bit SimHash of one document's words; no word: zero."""
    return int(_fingerprints([words], shingle)[0])


def _fingerprints(docs: list[list[bytes]], shingle: int) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(docs), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, words in enumerate(docs):
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= shingle:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - shingle]]).tolist()
        hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())])
        counts[i] = n - shingle + 1
    # Set bits by position, through a histogram of byte values at each of the eight byte places.
    h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(docs), np.uint64)
    edges = np.concatenate([[0], np.cumsum(counts)])
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    place = np.arange(8) * 256
    for i in np.flatnonzero(counts):
        seen = np.bincount((h[edges[i] : edges[i + 1]] + place).ravel(), minlength=2048).reshape(8, 256)
        over = (2 * (seen @ bits) > counts[i]).ravel()
        out[i] = np.packbits(over, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint long) of the lower-cased (A-Z) whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            found = [np.zeros(0, np.uint64)]
            for k in range(0, len(at) - 1, 256):
                part = at[k : k + 257]
                found.append(_fingerprints([raw[a:b].lower().split() for a, b in zip(part, part[1:])], shingle))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, fingerprint long")


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints, built and searched in bulk."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray):
        """A node is (point, {distance to it: subtree})."""
        top: dict = {}
        todo = [(members, top, 0)]
        while todo:
            members, into, key = todo.pop()
            node = members[0]
            d = np.bitwise_count(self.points[members[1:]] ^ self.points[node])
            children: dict = {}
            into[key] = (node, children)
            for e in np.unique(d):
                todo.append((members[1:][d == e], children, int(e)))
        return top[0]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of indices (query, point) within the radius, piece by piece."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, asked = todo.pop()
            point, children = node
            d = np.bitwise_count(queries[asked] ^ self.points[point]).astype(np.int64)
            near = asked[d <= radius]
            if len(near):
                yield near, np.full(len(near), point)
            for e, child in children.items():
                along = asked[np.abs(d - e) <= radius]
                if len(along):
                    todo.append((child, along))


def shard_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as index pairs."""
    forest = Forest(len(points))
    if len(points) > 1:
        for a, b in BKTree(points).search(points, radius):
            forest.link(a, b)
    return forest.edges


def _blocks(n: int, low: int = 0, high: int = 64) -> list[tuple[int, int]]:
    """Cuts bits low..high into n blocks (start, width)."""
    edges = [low + round(i * (high - low) / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def plan(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each way of dealing: its blocks. More fingerprints take longer keys and more ways; few take parts of blocks."""
    for blocks in range(radius + 1, 13):
        keys = [list(k) for k in combinations(_blocks(blocks), blocks - radius)]
        if n / 2.0 ** min(sum(w for _, w in k) for k in keys) <= LARGE_SHARD:
            break
    if blocks == radius + 1:
        # Values that agree in a block agree in a part of it.
        width = max(1, min(w for k in keys for _, w in k), 1)
        while width > 1 and n / 2.0**width < SMALL_SHARD:
            width -= 1
        keys = [[(start, min(w, width)) for start, w in k] for k in keys]
    return keys


def _shard_values(points: np.ndarray, key: list[tuple[int, int]]) -> np.ndarray:
    """Each fingerprint's bits in these blocks, as one number."""
    out = np.zeros(len(points), np.uint64)
    for start, width in key:
        out = out << np.uint64(width) | (points >> np.uint64(start)) & np.uint64((1 << width) - 1)
    return out


def broadcast_links(distinct: DataFrame, radius: int, ways: list[list[tuple[int, int]]], n: int) -> DataFrame:
    """Links (a, b) by trees built from the broadcast fingerprints; n: their number, at most BROADCAST."""
    spark = distinct.sparkSession
    points = np.sort(distinct.select("fp").toArrow()["fp"].to_numpy().view(np.uint64))  # at most 8 * BROADCAST bytes
    shared = spark.sparkContext.broadcast(points)
    bits = [sum(w for _, w in k) for k in ways]
    shards = sum(1 << b for b in bits)
    numbers = spark.range(0, shards, 1, max(1, min(shards, n * len(ways) // 2000 + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, held = shared.value, {}
        first = np.cumsum([0] + [1 << b for b in bits])
        for batch in batches:
            out = []
            for number in batch.column(0).to_pylist():
                way = int(np.searchsorted(first, number, "right")) - 1
                if way not in held:
                    values = _shard_values(points, ways[way])
                    held = {way: (order := np.argsort(values, kind="stable"), values[order])}
                order, values = held[way]
                a, b = np.searchsorted(values, [number - first[way], number - first[way] + 1]).tolist()
                p = points[order[a:b]]
                if len(p) > 1 and (pairs := shard_links(p, radius)):
                    out.append(p[np.array(pairs)])
            if out:
                found = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64))], names=["a", "b"])

    return numbers.mapInArrow(lean(run), "a long, b long")


def _value(blocks: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` in these blocks, as one number."""
    out = F.lit(0).cast("long")
    for start, width in blocks:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return out


def _dealt(ways: list[list[tuple[int, int]]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("way"), _value(k).alias("value")) for i, k in enumerate(ways)]))


def links(distinct: DataFrame, radius: int, hot_shard: int = HOT_SHARD, broadcast: int = BROADCAST) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of ``fp`` within ``radius``."""
    n = distinct.count()
    ways = plan(n, radius)
    if n <= broadcast:
        return broadcast_links(distinct, radius, ways, n)
    shards = distinct.select("fp", _dealt(ways).alias("s")).select("fp", "s.way", "s.value")
    sizes = shards.groupBy("way", "value").count()
    hot = sizes.where(F.col("count") > hot_shard).select("way", "value", F.lit(True).alias("hot"))
    hot = cut(few(hot, n * len(ways) // hot_shard))
    if not hot.isEmpty():
        # Inside a hot shard some of radius + 1 blocks of the other bits agrees as well.
        marked = shards.join(hot, ["way", "value"], "left")
        again = F.lit(None)
        for i, key in enumerate(ways):
            free = [b for b in range(64) if not any(a <= b < a + w for a, w in key)]
            parts = [free[a : a + w] for a, w in _blocks(radius + 1, 0, len(free))]
            subs = F.array(*[F.struct(F.lit(j).alias("part"), _value([(b, 1) for b in p]).alias("sub")) for j, p in enumerate(parts)])
            again = F.when(F.col("way") == i, subs).otherwise(again)
        once = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub")))
        shards = marked.select("fp", "way", "value", F.explode(F.when(F.col("hot"), again).otherwise(once)).alias("s")).select("fp", F.xxhash64("way", "value", "s.part", "s.sub").alias("shard"))
    else:
        shards = shards.select("fp", F.xxhash64("way", "value").alias("shard"))
    ordered = shards.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(points: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            p = np.unique(np.concatenate(points)) if len(points) > 1 else points[0]
            if len(p) > 1 and (pairs := shard_links(p, radius)):
                at = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(p[at[:, 0]].view(np.int64)), pa.array(p[at[:, 1]].view(np.int64))], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(shard):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(edges, edges[1:]):
                if held and shard[a] != key:
                    yield from linked(held)
                    held = []
                key = shard[a]
                held.append(fp[a:b])
        if held:
            yield from linked(held)

    return ordered.mapInArrow(lean(run), "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (fingerprint, component_id): the least doc_id reachable from each fingerprint."""
    distinct = cut(few(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), prints.count()))
    root = components(links(distinct.select("fp"), radius))
    # Fingerprints without a link are their own group; only the others meet by root.
    linked = distinct.join(root.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "least", "root")
    sizes = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    sizes = cut(few(sizes, prints.count()))
    most = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = sizes.where(F.col("n") > max(1000, most // 1000)).select("root")
    met = back_to_rows(linked.select("fp", "root"), sizes.select("root", "component_id"), ["root"], heavy).select(F.col("fp").alias("fingerprint"), "component_id")
    alone = distinct.join(root.select(F.col("node").alias("fp")), "fp", "left_anti").select(F.col("fp").alias("fingerprint"), F.col("least").alias("component_id"))
    return met.unionByName(alone)


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (long) and component_id (least doc_id of its group).

    Null and empty texts have fingerprint zero and link like any other. A
    group without any doc_id has component_id null. Rows of equal doc_id stay
    apart in the result. An empty table gives no rows. Only doc_id and the text
    are read, so further columns cannot clash.
    """
    prints = cut(fingerprints(docs, shingle, text))
    rows = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    heavy = rows.where(F.col("n") > max(1000, prints.count() // 1000)).select("fingerprint")
    return back_to_rows(prints, groups(prints, radius), ["fingerprint"], heavy).select("doc_id", "fingerprint", "component_id")


def tree_groups(texts: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Rows (key, id): the texts (id, text) whose fingerprints the trees link, by a key of each component."""
    prints = fingerprints(texts.select(F.col("id").alias("doc_id"), "text"), shingle)
    prints = cut(prints.select(F.col("doc_id").alias("id"), F.col("fingerprint").alias("fp")).distinct())
    root = components(links(cut(few(prints.select("fp").distinct(), prints.count())), radius))
    return prints.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("key"), "id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = minhash.SIMILARITY, text: str = "text", radius: int = WIDE) -> DataFrame:
    """The rows of ``docs`` that remain when one of each group of near duplicates stays.

    Candidates are the texts of one component of fingerprints that the sharded
    trees link within ``radius`` bits, and, as alike texts may lie farther apart
    than any radius that shards can serve, those that share a MinHash key. Of
    them the pairs whose sets of shingles have at least this Jaccard similarity
    are linked, and components of links are groups. What stays is the row of least doc_id (null before all),
    then of least text hash; of rows equal in both, the first by source,
    language and then the other columns. Columns of ``docs`` stay as they are.
    """
    own = docs.columns
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(t).alias("_hash"))
    # The id of a text is its hash.
    texts = docs.select(F.xxhash64(t).alias("id"), t.alias("text"))
    grouped = minhash.groups(texts, shingle, similarity, besides=tree_groups(texts, shingle, radius))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("_hash")).join(grouped.withColumnRenamed("node", "_hash"), "_hash", "left")
    stays = named.groupBy(F.coalesce("root", "_hash").alias("group")).agg(F.min(F.struct("doc_id", "_hash")).alias("m")).select(F.col("m.doc_id").alias("_i"), F.col("m._hash").alias("_h"))
    kept = keyed.join(stays, keyed["_id"].eqNullSafe(stays["_i"]) & (keyed["_hash"] == stays["_h"]), "left_semi")
    order = [F.col(f"_row.`{c}`") for c in ("source", "lang") if c in own]
    rest = [F.col(f"_row.`{c}`").alias(c) for c in own if c not in ("doc_id", text, "source", "lang")]
    if rest:
        order.append(F.to_json(F.struct(*rest)))
    first = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(*(order or [F.lit(0)])))
    return kept.withColumn("_n", first).where("_n = 1").select(*[F.col(f"_row.`{c}`").alias(c) for c in own])
