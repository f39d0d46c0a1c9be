"""Path and name keys, and parts of paths, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def nfc(c: Column) -> Column:
    """NFC; only text that is not ASCII goes through Python."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(_nfc(c))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_key(c: Column, convention: str) -> Column:
    """The key under which a path is the same file: exact, ascii (fold A-Z) or nfc (normalise, fold A-Z)."""
    if convention == "exact":
        return c
    return ascii_lower(c if convention == "ascii" else nfc(c))


def name_key(c: Column) -> Column:
    """Trimmed, normalised and lower-cased in all of Unicode."""
    return F.lower(nfc(F.trim(c)))


def last_part(c: Column) -> Column:
    """The last part of a path that is not empty."""
    return F.try_element_at(F.filter(F.split(c, "/"), lambda x: x != ""), F.lit(-1))


def slashed(c: Column) -> Column:
    """Backslashes made slashes, and a verbatim prefix taken off."""
    plain = F.regexp_replace(c, r"^\\\\\?\\(UNC\\)?", "")
    return F.translate(plain, "\\", "/")


def relative_to(c: Column, base: Column) -> Column:
    """The path below ``base``; null if it isn't below it."""
    return F.when(c == base, "").when(F.startswith(c, F.concat(base, F.lit("/"))), F.substr(c, F.length(base) + 2))


def split_name(c: Column) -> tuple[Column, Column]:
    """(stem, extension) at the last dot; without one the extension is arw."""
    dotted = F.contains(c, F.lit("."))
    return F.when(dotted, F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).otherwise(c), F.when(dotted, F.regexp_extract(c, r"\.([^.]*)$", 1)).otherwise("arw")


def is_supported(c: Column, kinds: tuple[str, ...] = ("arw",)) -> Column:
    return F.lower(F.regexp_extract(c, r"[.]([^.]+)$", 1)).isin(*kinds)


def uuid_text(hex32: Column) -> Column:
    """32 hex digits as 8-4-4-4-12, upper case."""
    h = F.upper(hex32)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def mount_unescaped(c: Column) -> Column:
    """The octal escapes that mount tables use for white space and backslashes."""
    for code, text in ((r"\\040", " "), (r"\\011", "\t"), (r"\\012", "\n"), (r"\\134", r"\\")):
        c = F.regexp_replace(c, code, text)
    return c


def families(stem: Column) -> Column:
    """A stem without the numbers that counting puts behind it: names of two families never meet."""
    return F.regexp_replace(stem, r"(-[0-9]+)+$", "")
