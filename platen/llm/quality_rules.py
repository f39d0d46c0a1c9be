"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built-in column functions: no user function, no shuffle, one
pass over the text. A null text counts as empty. Rows repeat, tie or carry
further columns without effect on one another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to a in is it that was for on are with as be at this have from or by not but what all were when "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de des et un une en est que qui dans pour pas sur au par plus ne se avec ce il sont son "
    "el los las y del se con por su para como más lo pero sus al entre una no es"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose ``measure`` lies outside [least, most]."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are per word or per line with a word.
RULES = (
    Rule("length", "n_words", least=20),
    Rule("word_length", "chars_per_word", least=1.5, most=25.0),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("duplicate_lines", "dup_line_ratio", most=0.6),
    Rule("stutter", "stutter_ratio", most=0.3),
    Rule("bullets", "bullet_ratio", most=0.9),
)


def let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(hashes: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places on; as many as have one."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, by + 1, n), lambda x, y: F.xxhash64(x, y))


def _covered(hashes: Column) -> Column:
    """Words within windows that occur at least twice, from all windows' hashes in order."""

    def starts(s: Column) -> Column:
        n = F.size(s)
        return F.array_sort(
            F.transform(
                F.filter(
                    s,
                    lambda x, i: ((i > 0) & (F.get(s, i - 1).getField("h") == x.getField("h"))) | ((i < n - 1) & (F.get(s, i + 1).getField("h") == x.getField("h"))),
                ),
                lambda x: x.getField("i"),
            )
        )

    def total(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(starts(s), total)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_m`` of the base counts and the rules' measures.

    Windows are compared by a 64-bit hash of their eight words; two different
    windows of one document share one with a chance below 1e-10 even for a
    text of 20,000 words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", F.array_remove(F.split(t, r"\s+"), ""))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S")))
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = let(F.col("_h"), lambda h: let(_shifted(h, 1), lambda h2: let(_shifted(h2, 2), lambda h4: _shifted(h4, 4))))
    d = d.withColumn("_windows", windows)
    n = F.size("_words").cast("long")
    lines = F.size("_lines")
    per_word = F.greatest(n, F.lit(1))
    per_line = F.greatest(lines, F.lit(1))
    symbols = F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long")
    chars = F.length(F.array_join("_words", "")).cast("long")
    repeats = F.size(F.array_distinct("_lines"))
    stop_words = F.size(F.array_intersect(F.transform(F.array_distinct("_words"), lambda w: F.lower(w)), F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])))
    kinds = F.greatest(F.size(F.array_distinct("_h")), F.lit(1))
    before = F.slice("_h", 1, F.greatest(F.size("_h") - 1, F.lit(0)))
    after = F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(0)))
    stutter = F.size(F.filter(F.zip_with(before, after, lambda x, y: x == y), lambda x: x))
    bullets = F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]")))
    found = F.struct(
        n.alias("n_words"),
        chars.alias("word_chars"),
        symbols.alias("n_symbols"),
        (lines - repeats).cast("long").alias("n_dup_lines"),
        _covered(F.col("_windows")).alias("n_repeat_words"),
        (chars / per_word).alias("chars_per_word"),
        (symbols / per_word).alias("symbols_per_word"),
        (stop_words / F.least(kinds, F.lit(100))).alias("stop_ratio"),
        ((lines - repeats) / per_line).alias("dup_line_ratio"),
        (stutter / per_word).alias("stutter_ratio"),
        (bullets / per_line).alias("bullet_ratio"),
    )
    return d.withColumn("_m", found).drop("_words", "_lines", "_h", "_windows")


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression over ``_m``."""
    ok = F.lit(True)
    for r in rules:
        m = F.col(f"_m.{r.measure}")
        if r.least is not None:
            ok = ok & (m >= r.least)
        if r.most is not None:
            ok = ok & (m <= r.most)
    return ok


def quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, the measures, base_failed and kept.

    An empty or null text has no words: base_failed is true and kept false.
    Only doc_id and the text are read, so further columns cannot clash.
    """
    d = measure(docs.select("doc_id", F.col(text).alias("_text")), "_text")
    m = [F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = (F.col("_m.n_words") < 20) | (100 * F.col("_m.n_repeat_words") > 30 * F.col("_m.n_words"))
    return d.select("doc_id", *m, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    own = docs.columns
    d = measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(text).alias("_text")), "_text")
    failed = (F.col("_m.n_words") < 20) | (100 * F.col("_m.n_repeat_words") > 30 * F.col("_m.n_words"))
    return d.where(~failed & verdict(rules)).select(*[F.col(f"_row.`{c}`").alias(c) for c in own])
