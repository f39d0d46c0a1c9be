"""Listings of files, with content hashes and the metadata that headers hold."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import is_supported

#: TIFF tags read from a header, and their fields.
TAGS = {271: "camera_make", 272: "camera_model", 306: "taken"}
#: Bytes of a file that metadata are looked for in.
HEAD = 64 * 1024


def listing(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("arw",), contents: bool = False) -> DataFrame:
    """Files below root (path, size, mtime), with content_hash if asked; contents are read only then."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(is_supported(F.col("path"), kinds))
    columns = ["path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime")]
    return found.select(*columns, *([F.sha2("content", 256).alias("content_hash")] if contents else []))


def known(store, root: str) -> DataFrame:
    """The store's files as paths below root, for classifying a listing."""
    files, folders = store.table("files"), store.table("folders")
    joined = files.join(folders.select(F.col("id").alias("folder_id"), "relative_path"), "folder_id")
    path = F.regexp_replace(F.concat_ws("/", F.lit(root.rstrip("/")), "relative_path", "filename"), "(?<!:)/{2,}", "/")
    return joined.select(path.alias("path"), "size", "mtime", "content_hash", "missing")


def header(data: bytes) -> dict[str, str | None]:
    """Camera and time from the first directory of a TIFF header; anything out of bounds is left out."""
    out: dict[str, str | None] = dict.fromkeys(TAGS.values())
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        return out
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42 or at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        place = at + 2 + 12 * k
        if place + 12 > len(data):
            break
        tag, kind, count, value = struct.unpack_from(order + "HHII", data, place)
        if tag in TAGS and kind == 2 and 0 < count <= 256:
            start = place + 8 if count <= 4 else value
            if start + count <= len(data):
                out[TAGS[tag]] = data[start : start + count].split(b"\0")[0].decode("latin-1").strip() or None
    return out


def with_metadata(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("arw",)) -> DataFrame:
    """Files below root with camera_make, camera_model and taken (text) from their headers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(is_supported(F.col("path"), kinds))
    heads = found.select("path", "length", F.substring("content", 1, HEAD).alias("head"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [header(bytes(h)) for h in f["head"]]
            yield pd.DataFrame({"path": f["path"], "size": f["length"], **{c: [r[c] for r in rows] for c in TAGS.values()}})

    kinds_of = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), *[T.StructField(c, T.StringType()) for c in TAGS.values()]])
    return heads.mapInPandas(read, kinds_of)
