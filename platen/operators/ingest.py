"""Incremental ingest: listing, scan classification, relinking, verified copies, name collisions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import families, is_supported


def listing(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("arw",)) -> DataFrame:
    """Files below ``root`` of the supported kinds: path, size, mtime. File contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime")).where(is_supported(F.col("path"), kinds))


def classified(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (path, action): added, updated (size or mtime differs), unchanged or missing."""
    a = listed.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.lit(True).alias("_here"))
    b = known.select("path", "size", "mtime", F.lit(True).alias("_known"))
    action = (
        F.when(F.col("_known").isNull(), "added")
        .when(F.col("_here").isNull(), "missing")
        .when(F.col("_s").eqNullSafe(F.col("size")) & F.col("_m").eqNullSafe(F.col("mtime")), "unchanged")
        .otherwise("updated")
    )
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def merged(known: DataFrame, listed: DataFrame) -> DataFrame:
    """The files after a scan: new ones added, changed ones without their hash, absent ones marked missing."""
    actions = classified(listed, known)
    now = listed.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    out = actions.join(known, "path", "left").join(now, "path", "left")
    keep = F.col("action").isin("unchanged", "missing")
    return out.select("path", F.coalesce("_s", "size").alias("size"), F.coalesce("_m", "mtime").alias("mtime"), F.when(keep, F.col("content_hash")).alias("content_hash"), (F.col("action") == "missing").alias("missing"))


def under(path: Column, folder: Column | str) -> Column:
    """Whether a path is the folder or lies below it (no pattern: names may hold % and _)."""
    f = folder if isinstance(folder, Column) else F.lit(folder)
    return (path == f) | F.startswith(path, F.concat(f, F.lit("/")))


def marked_missing(known: DataFrame, seen: DataFrame, scanned: str) -> DataFrame:
    """``known`` with missing set where a file below the scanned folder was not seen."""
    return known.join(seen.select("path", F.lit(True).alias("_seen")), "path", "left").withColumn("missing", F.col("missing") | (under(F.col("path"), scanned) & F.col("_seen").isNull())).drop("_seen")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def relinked(missing: DataFrame, candidates: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (id, path, outcome) of missing files by their content hash.

    relinked: one missing row and at least one unheld candidate of the hash
    (the first path is taken); ambiguous: several missing rows share the hash;
    still_missing: no candidate; unhashed: the hash was never known.
    """
    free = candidates.join(held.select("path"), "path", "left_anti")
    first = free.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("path").alias("path"))
    twins = missing.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("_n"))
    out = missing.select("id", "content_hash").join(twins, "content_hash", "left").join(first, "content_hash", "left")
    outcome = F.when(F.col("content_hash").isNull(), "unhashed").when(F.col("path").isNull(), "still_missing").when(F.col("_n") > 1, "ambiguous").otherwise("relinked")
    return out.select("id", F.when(outcome == "relinked", F.col("path")).alias("path"), outcome.alias("outcome"))


def day_folder(captured_at: Column) -> Column:
    """undated, or YYYY/YYYY-MM-DD of the camera's wall clock."""
    return F.coalesce(F.date_format(F.timestamp_seconds(captured_at), "yyyy/yyyy-MM-dd"), F.lit("undated"))


def wall_clock(text: Column) -> Column:
    """Seconds since 1970 of ``YYYY?MM?DD HH?MM?SS`` read by position; null if any part is out of range."""

    def part(a: int, n: int) -> Column:
        return F.substring(text, a, n).try_cast("int")

    y, mo, d, h, mi, s = part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2)
    fine = (y >= 1970) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 60) & (F.length(text) >= 19)
    # A day beyond its month's end runs on into the next month.
    first = F.unix_date(F.make_date(F.when(fine, y), F.when(fine, mo), F.when(fine, F.lit(1))))
    return F.when(fine, (first.cast("long") + d - 1) * 86400 + h * 3600 + mi * 60 + s)


def placed(sources: DataFrame, there: DataFrame) -> DataFrame:
    """Where card files go: (id, folder, name, placed, already).

    In order of id. A file whose wanted name is free takes it. Where the name is
    held by the same content, the file is already there; where by another, the
    next of name-2, name-3 ... is looked at in the same way. Names are settled
    within a folder and a family of stems, which are dealt to tasks; a task
    keeps the names of one family at a time.
    """

    def run(batches):
        family, held, chains = None, {}, {}
        for batch in batches:
            out = []
            for folder, f, kind, id_, name, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "_f", "_kind", "id", "name", "content_hash"))):
                if (folder, f) != family:
                    family, held, chains = (folder, f), {}, {}
                if not kind:
                    held.setdefault(name, content)
                    continue
                stem, _, ext = name.rpartition(".") if "." in name else (name, "", "arw")
                # The names looked at so far for this one, by content, and the number of the next.
                chain = chains.setdefault(name, [{}, 1])
                while (target := name if chain[1] == 1 else f"{stem}-{chain[1]}.{ext}") in held:
                    chain[0].setdefault(held[target], target)
                    chain[1] += 1
                already = content is not None and content in chain[0]
                if not already:
                    held[target] = content
                out.append((id_, folder, name, None if already else target, already))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["id", "folder", "name", "placed", "already"])

    def side(rows: DataFrame, kind: int, key: Column) -> DataFrame:
        stem = F.regexp_replace("name", r"\.[^.]*$", "")
        return rows.where("name IS NOT NULL").select(key.cast("long").alias("id"), F.col("folder").cast("string").alias("folder"), "name", "content_hash", F.lit(kind).alias("_kind"), families(stem).alias("_f"))

    both = side(there, 0, F.lit(None)).unionByName(side(sources, 1, F.col("id")))
    dealt = both.repartition("folder", "_f").sortWithinPartitions("folder", "_f", "_kind", "id", "name", "content_hash")
    return dealt.mapInArrow(run, "id long, folder string, name string, placed string, already boolean")
