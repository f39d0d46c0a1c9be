"""Pieces the training-data operators share: word arrays, lineage cuts, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only bytes that separate words: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of a word that are hashed eight at a time, all words together; longer words go one by one.
LANES = 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Bytes of text handled at once, so that the 8-byte arrays beside them stay small.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words data[start:end].

    Eight bytes at a time are mixed into a state that starts from the word's
    length, so no linear pattern of bytes cancels out, and words of one length
    up to eight bytes never share a hash.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * _LEFT + np.uint64(2 * seed + 1))
    if not len(out):
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    some = slice(None)
    for lane in range(LANES):
        at, left = start[some] + 8 * lane, size[some] - 8 * lane
        value = np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0] & _MASK[np.minimum(left, 8)]
        out[some] = mix(out[some] ^ value)
        some = np.flatnonzero(size > 8 * lane + 8)
        if not len(some):
            return out
    for i in some.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about so many bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """The words of a range of documents as arrays.

    start, end: byte positions in ``data``; hash: 64-bit hash of each word;
    first: index of each document's first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.data, n = data, len(data)
        solid = ~_SPACE[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = solid[edges]
        ends[edges - 1] = solid[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if hashed:
            self.hash = self.hashes()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """The words' hashes; each seed gives others."""
        return word_hashes(self.data, self.start, self.end, seed)

    def doc(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, length: int) -> np.ndarray:
        """Word positions at which a window of so many words of one document starts."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self.start))
        return np.flatnonzero(left >= length)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of each a[i] followed by b[i]; the longer of the two is cut."""
    n = min(len(a), len(b))
    x = a[:n] * _LEFT ^ b[:n]
    x ^= x >> np.uint64(32)
    x *= _RIGHT
    x ^= x >> np.uint64(29)
    return x


def rolled(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Keys of all runs of ``length`` hashes: halves are mixed into wholes, by doubling.

    Every step mixes, so runs of few and regular words cancel no better than others.
    """
    if len(words) < length:
        return words[:0]
    whole, out, done, block, size = len(words) - length + 1, None, 0, words ^ mix(np.array([seed], np.uint64)), 1
    while length:
        if length & 1:
            out = block[done:] if out is None else _pair(out, block[done:])
            done += size
        length >>= 1
        if length:
            block = _pair(block, block[size:])
            size *= 2
    return mix(out[:whole])


def sliding(values: np.ndarray, length: int, fold) -> np.ndarray:
    """fold (np.minimum or np.maximum) over all runs of ``length`` values, by doubling."""
    if len(values) < length:
        return values[:0]
    block, size = values, 1
    while size * 2 <= length:
        block = fold(block[:-size], block[size:])
        size *= 2
    return fold(block[: len(values) - length + 1], block[length - size :]) if size < length else block


def lean(run):
    """``run`` as a map function that returns its free memory to the system when its task ends.

    Workers live on between tasks; what their allocators keep would add up.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        import ctypes

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library

    return wrapped


#: Freed blocks of at least so many bytes go back to the system at once (glibc lets this grow to 32 MB by itself).
OWN_BLOCK = 1 << 20


def tight() -> None:
    """Keeps this worker small: large arrays leave no holes behind, and the tokenizer starts no threads of its own.

    Executors run a worker for each core, so threads inside one only take memory.
    """
    import ctypes
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    try:
        ctypes.CDLL(None).mallopt(-3, OWN_BLOCK)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):
        pass  # another C library


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Inside, plans that are run send Python workers at most so many rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's spark.checkpoint.dir; where it is unset a local session gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="platen-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_anew(df: DataFrame) -> DataFrame:
    """The rows of a cut ``df`` without the planner's estimate of their size.

    Estimates of joins are products; carried from round to round they grow into
    numbers of many thousand digits, and planning stands still.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as so many (narrow) rows are worth, without a shuffle."""
    return df.coalesce(max(8, -(-rows // 200_000)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (node, root).

    Each round every node moves to its neighbour (or itself) of least hashed
    rank and the edges are renamed accordingly; as ranks are random, a constant
    share of the nodes goes in each round, for any shape of component. ``root``
    is some node of the component. Only nodes that have an edge are returned.
    """
    def rank(c: str, salt: int):
        return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("v"))

    edges = sized_anew(cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    steps: list[DataFrame] = []
    most = left = edges.count()
    while left:
        salt = len(steps)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy("a").agg(F.min(rank("b", salt)).alias("m"))
        move = sized_anew(cut(few(moved.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a", salt)).getField("v").alias("to")), 2 * left)))
        steps.append(move)
        renamed = (
            edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = sized_anew(cut(few(renamed, left)))
        left = edges.count()
    spark = edges.sparkSession
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps[0].select("node", F.col("to").alias("root"))
    for move in steps[1:]:
        out = out.join(move.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return sized_anew(cut(few(out, 2 * most)))


#: Parts that a key of very many rows is spread over when a result goes back to them.
SPREAD = 64
#: Bits of a filter of ids, at most: 8 MB.
FILTER_BITS = 1 << 26
#: Keys that a task remembers to drop rows of equal key.
REMEMBERED = 1 << 19


def first_seen(*keys: str):
    """A map function that drops rows whose ``keys`` its task has sent already (it forgets all beyond REMEMBERED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            fresh = []
            for key in zip(*(batch.column(k).to_pylist() for k in keys)):
                fresh.append(key not in seen)
                seen.add(key)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return run


def bit_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A bit for the low bits of each ``id``; ids not asked for may share one. At most FILTER_BITS come to the driver."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    place = F.col("id").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = ids.select(place.alias("p")).selectExpr("shiftright(p, 6) AS word", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def in_filter(key: str, asked: np.ndarray):
    """A map function that keeps the rows whose ``key`` the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(key).to_numpy().view(np.uint64) & np.uint64(64 * len(asked) - 1)
            yield batch.filter(pa.array((asked[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return run


def back_to_rows(rows: DataFrame, made: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``rows`` joined with ``made`` (one row per ``keys``, never null).

    heavy: the keys of over a thousandth of all rows, so fewer than a thousand;
    they are broadcast, and rows of these keys are spread over SPREAD tasks.
    """
    heavy = F.broadcast(heavy.select(*keys, F.lit(SPREAD).alias("_ways")))
    many = F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))
    made = made.join(heavy, keys, "left").withColumn("_way", many).drop("_ways")
    way = F.when(F.col("_ways").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int"))
    return rows.join(heavy, keys, "left").withColumn("_way", way).drop("_ways").join(made, [*keys, "_way"]).drop("_way")


class Forest:
    """Union-find over 0..n-1 whose labels are kept flat for vectorised lookups."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i]; keeps only the links that join two trees."""
        # In pieces: what the first ones join, the others need not sort.
        for k in range(0, len(a), 1 << 14):
            self._link(a[k : k + (1 << 14)], b[k : k + (1 << 14)])

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        _, pick = np.unique(np.stack([np.minimum(la, lb), np.maximum(la, lb)]), axis=1, return_index=True)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for i in pick.tolist():
            x, y = root(int(la[i])), root(int(lb[i]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((int(a[i]), int(b[i])))
        old = np.fromiter(parent, np.int64, len(parent))
        to = np.arange(len(self.label))
        to[old] = [root(int(x)) for x in old]
        self.label = to[self.label]
