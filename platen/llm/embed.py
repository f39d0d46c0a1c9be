"""Embedding near-duplicates: cross-polytope hashing, multiprobe buckets, verified pairs.

A vector is turned by random sign flips and fast Hadamard transforms and named
by its largest coordinate and that coordinate's sign; ``turns`` such names make
a bucket of one of ``tables`` tables. A vector lies in its own bucket of each
table and visits the ``PROBES`` next likely ones. More vectors take more turns,
so that buckets stay small, and more turns take more tables, so that recall
stays the same (``search_plan``).

1. Buckets hold a 63-bit sign sketch of each vector, not the vector. Two that
   meet in a bucket are candidates if their sketches differ in at most
   ``sketch_radius`` bits, which a pair at the threshold all but never exceeds.
   A bucket yields a spanning forest of its candidates, never pairs.
2. Components of candidates are blocks: each vector that has a candidate goes to
   its block once, and there every pair is verified by its cosine in double
   precision. So no false link is returned, and pairs of a block link even if
   they share no bucket. A block yields each vector's number of links and a
   spanning forest of the links.

Equal vectors are one class. Buckets and blocks of more entries than a task
should compare are cut into parts whose pairs are dealt to many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, back_to_rows, bit_filter, components, cut, few, first_seen, in_filter, lean, mix

THRESHOLD = 0.95
#: Share of the pairs at the threshold that the buckets are to bring together.
RECALL = 0.97
PROBES = 2
ROUNDS = 3
#: Entries that one bucket has on average at most.
CROWD = 64
#: Entries of a bucket that one task compares with another part's, and numbers (entries x dimensions) for a block.
BLOCK = 1 << 14
NUMBERS = 1 << 20
SEED = 977
_PRIME = np.int64(2**31 - 1)


def _padded(dim: int) -> int:
    return 1 << max(1, math.ceil(math.log2(max(dim, 2))))


def search_plan(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(turns, tables) for n vectors.

    One table brings a pair at cosine 0.95 together with a chance of at least
    exp(-0.057 (b - 6)) where its buckets' names have b bits, measured for 16 to
    1024 dimensions with two probes; for other cosines the exponent scales as
    the theory of the hash has it. Tables are as many as ``recall`` needs.
    """
    bits = math.log2(2 * _padded(dim))
    turns = max(1, math.ceil(math.log2(max(1.0, n * (1 + PROBES) / CROWD)) / bits))
    far = 2 * (1 - threshold)
    chance = math.exp(-0.057 * max(1.0, turns * bits - 6) * (far / (4 - far)) / (0.1 / 3.9))
    return turns, max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(chance, 0.999))))


def sketch_radius(threshold: float) -> int:
    """Differing sign bits (of 63) that a pair at the threshold exceeds with a chance below 1e-5."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(63 * p + 4.4 * math.sqrt(63 * p * (1 - p)))


def _hadamard(a: np.ndarray) -> np.ndarray:
    size, h = a.shape[1], 1
    while h < size:
        pairs = a.reshape(len(a), -1, 2, h)
        a = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(a), size)
        h *= 2
    return a


def codes(vectors: np.ndarray, tables: int, turns: int, probes: int) -> np.ndarray:
    """For each vector and table: its bucket, then the buckets it visits (int32)."""
    n, dim = vectors.shape
    size = _padded(dim)
    x = np.zeros((n, size))
    x[:, :dim] = vectors
    rng = np.random.default_rng(SEED)
    rows = np.arange(n)
    near = min(size, probes + 1)
    out = np.empty((n, tables, 1 + probes), np.int32)
    for t in range(tables):
        names, gaps, others = [], [], []
        for _ in range(turns):
            y = x
            for _ in range(ROUNDS):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size)) / math.sqrt(size)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, top, 1)
            names.append(top * 2 + (value < 0))
            gaps.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
        scale = [np.int64(pow(2 * size, k, int(_PRIME))) for k in range(turns)]
        bucket = sum(names[k][:, 0] * scale[k] for k in range(turns)) % _PRIME
        for k in range(turns):
            others.append((bucket[:, None] + (names[k][:, 1:] - names[k][:, :1]) * scale[k]) % _PRIME)
        gap, other = np.concatenate(gaps, 1), np.concatenate(others, 1)
        best = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = bucket
        out[:, t, 1:] = other[rows[:, None], best] if best.shape[1] == probes else np.pad(other[rows[:, None], best], ((0, 0), (0, probes - best.shape[1])), constant_values=-1)
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, safe for very large and small components."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(vectors: np.ndarray) -> np.ndarray:
    """The signs of 63 coordinates after turns, as bits 1 to 63."""
    n, dim = vectors.shape
    size = max(64, _padded(dim))
    y = np.zeros((n, size))
    y[:, :dim] = vectors
    rng = np.random.default_rng(SEED + 1)
    for _ in range(ROUNDS):
        y = _hadamard(y * rng.choice([-1.0, 1.0], size))
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 1:] = y[:, :63] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _by_dimension(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector in a batch."""
    dims = np.array([len(v) for v in lists], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(dims)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for k in range(0, len(rows), 4096):
            some = rows[k : k + 4096]
            yield some, flat[(ends[some] - dim)[:, None] + np.arange(dim)]


def _entries(turns: int, tables: int, probes: int):
    """Rows (key, class, sketch) of each vector's buckets; bit 0 of the sketch: the bucket is the vector's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("class").to_numpy()
            for rows, raw in _by_dimension(batch.column("embedding")):
                unit = _unit(raw)
                found = codes(unit, tables, turns, probes).astype(np.int64)
                place = np.arange(tables, dtype=np.int64)[None, :, None] << 32 | np.int64(raw.shape[1]) << 44
                key = mix((found + place).astype(np.uint64)).view(np.int64)
                own = np.zeros(found.shape, np.uint64)
                own[:, :, 0] = 1
                sketch = _signs(unit)[:, None, None] | own
                # Two of a vector's entries never share a bucket, but for buckets that do not exist.
                real = found >= 0
                name = np.broadcast_to(names[rows][:, None, None], found.shape)
                yield pa.RecordBatch.from_arrays([pa.array(key[real]), pa.array(name[real]), pa.array(sketch[real].view(np.int64))], names=["key", "class", "sketch"])

    return run


def _sections(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]]).tolist()
        for a, b in zip(edges, edges[1:]):
            if held and k[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _met(radius: int):
    """Candidates of each bucket, or of two parts of one (``part`` tells them apart), as a spanning forest (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sections(batches, "key"):
            if t.num_rows < 2:
                continue
            ids, node = np.unique(t["class"].to_numpy(), return_inverse=True)
            sketch, part = t["sketch"].to_numpy().view(np.uint64), t["part"].to_numpy()
            own = (sketch & np.uint64(1)).astype(bool)
            if len(ids) < 2 or not own.any():
                continue
            forest, cross = Forest(len(ids)), part.min() != part.max()
            bases, bare = np.flatnonzero(own), sketch >> np.uint64(1)
            step = max(1, (1 << 22) // len(bare))
            for k in range(0, len(bases), step):
                base = bases[k : k + step]
                i, j = np.nonzero(np.bitwise_count(bare[base][:, None] ^ bare[None, :]) <= radius)
                i = base[i]
                use = (node[i] != node[j]) & (~own[j] | (i < j))
                if cross:
                    use &= part[i] != part[j]
                forest.link(node[i[use]], node[j[use]])
            if forest.edges:
                at = np.array(forest.edges)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """``rows`` once for each pair of parts of their group that holds theirs: with ``part`` and the pair's ``pair``.

    sizes: (key, parts) of the groups that have several.
    """
    met = rows.join(sizes, key, "left")
    n = F.coalesce("parts", F.lit(1))
    met = met.withColumn("part", F.pmod(F.xxhash64("class", F.lit(3)), n.cast("long")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return met.withColumn("pair", F.xxhash64(key, F.least("part", "_other"), F.greatest("part", "_other"))).drop("parts", "_other")


def _verify(threshold: float):
    """Links of each block, or of two parts of one: rows (kind, a, b): 0 number of a class's links, 1 a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sections(batches, "pair"):
            if t.num_rows < 2:
                continue
            name, first = np.unique(t["class"].to_numpy(), return_index=True)
            t = t.take(pa.array(first))
            dims = np.array([len(v) for v in t["embedding"]], np.int64)
            n, part = t["n"].to_numpy(), t["part"].to_numpy()
            cross = part.min() != part.max()
            links, forest = np.zeros(len(name), np.int64), Forest(len(name))
            column = t["embedding"].combine_chunks()
            flat = (column if isinstance(column, pa.Array) else column.chunk(0)).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = _unit(flat[(ends[rows] - dim)[:, None] + np.arange(dim)])
                step = max(1, (1 << 22) // len(rows))
                for k in range(0, len(rows), step):
                    i, j = np.nonzero(x[k : k + step] @ x.T >= threshold)
                    i = i + k
                    use = (i < j) & (part[rows[i]] != part[rows[j]] if cross else True)
                    i, j = rows[i[use]], rows[j[use]]
                    links += (np.bincount(i, n[j], len(links)) + np.bincount(j, n[i], len(links))).astype(np.int64)
                    forest.link(i, j)
            some = np.flatnonzero(links)
            if len(some):
                at = np.array(forest.edges).reshape(-1, 2)
                kind = np.repeat([0, 1], [len(some), len(at)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(np.concatenate([name[some], name[at[:, 0]]])), pa.array(np.concatenate([links[some], name[at[:, 1]]]))], names=["kind", "a", "b"]
                )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, column: str = "embedding", key: str = "vec_id", plan: tuple[int, int] | None = None) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id and kept.

    A vector that is null, empty, zero or holds null or non-finite components
    links with nothing; vectors of different length never link. Rows that
    repeat a vector are linked with each other, and those of equal vec_id too
    if their vectors are near. A row without vec_id keeps component_id null
    unless its group has ids. Integer arrays count as doubles. An empty table
    gives no rows. Only the two columns are read, so further columns cannot
    clash. plan: (turns, tables) instead of those of ``search_plan``.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    if rows.schema["embedding"].dataType.elementType.simpleString() not in ("float", "double"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    sound = F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.withColumn("embedding", F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")))
    # Classes go by a 64-bit hash of their vector: ids may repeat or be null.
    rows = rows.withColumn("class", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.lit(1))))
    valid = rows.where("class IS NOT NULL")
    classes = cut(valid.groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")))
    n, dim, total = classes.agg(F.count("*"), F.max("dim"), F.sum("n")).first()
    turns, tables = plan or search_plan(n, dim or 2, threshold, recall)
    kind = rows.schema["embedding"].dataType.simpleString()
    own = valid.select("class", "embedding").mapInArrow(lean(first_seen("class")), f"class long, embedding {kind}")
    entries = own.mapInArrow(lean(_entries(turns, tables, PROBES)), "key long, class long, sketch long")
    met = lean(_met(sketch_radius(threshold)))
    # A bucket of many is rare: it is looked for among the sums of tasks, and only its entries are dealt again.
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    sizes = cut(few(sizes.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), n))
    if sizes.isEmpty():
        dealt = entries.withColumn("part", F.lit(0))
    else:
        dealt = _dealt(entries, sizes, "key").drop("key").withColumnRenamed("pair", "key").select("key", "class", "sketch", "part")
    near = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(met, "a long, b long")
    block = components(near)
    # Only vectors that have a candidate move; the filter has a fixed size and may let a few more through.
    asked = bit_filter(block.select(F.col("node").alias("id")), block.count())
    moving = own.mapInArrow(lean(in_filter("class", asked)), f"class long, embedding {kind}")
    placed = moving.join(block.select(F.col("node").alias("class"), "root"), "class").join(classes.select("class", "n"), "class")
    most = max(64, NUMBERS // max(1, dim or 1))
    crowded = block.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > most).select("root", F.ceil(F.col("size") / most).cast("int").alias("parts"))
    dealt = _dealt(placed, cut(few(crowded, n // most + 1)), "root").select("pair", "class", "n", "part", "embedding")
    found = cut(dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(lean(_verify(threshold)), "kind long, a long, b long"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("links"))
    root = components(found.where("kind = 1").select("a", "b"))
    known = classes.join(links, "class", "left").join(root.select(F.col("node").alias("class"), "root"), "class", "left")
    known = known.select("class", "least", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("class", "n_links", "component_id")
    heavy = classes.where(F.col("n") > max(1000, (total or 0) // 1000)).select("class")
    linked = back_to_rows(rows.where("class IS NOT NULL").select("vec_id", "class"), known, ["class"], heavy).select("vec_id", "n_links", "component_id")
    alone = rows.where("class IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
