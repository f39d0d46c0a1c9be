"""Word hashes that no pattern of letters defeats, and a sketch that stays selective as the corpus grows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from platen.llm import packing, substring
from platen.llm.common import Words, rolled, utf8, word_hashes
from platen.llm.queries import word_tokenizer


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def words_of(*texts):
    return Words(*utf8(pa.array(texts)))


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 4096])
def test_patterned_words_differ(n):
    w = words_of(thue_morse(n) + " " + thue_morse(n, "b", "a"))
    assert len(set(w.hash.tolist())) == 2 and len(set(w.hashes(1).tolist())) == 2


def test_hash_is_of_the_bytes_alone():
    r = random.Random(1)
    words = ["".join(r.choice("abé0") for _ in range(r.randint(1, 200))) for _ in range(500)]
    there = words_of(*words).hash
    text = "  ".join(reversed(words))
    assert words_of(text).hash.tolist() == there.tolist()[::-1]
    assert len(set(there.tolist())) == len(set(words))
    assert word_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_runs_of_two_words_differ():
    h = words_of(" ".join(thue_morse(64))).hash
    for length in (2, 3, 8, 32, 35):
        runs = {tuple(h[i : i + length].tolist()) for i in range(64 - length + 1)}
        assert len(set(rolled(h, length, 7).tolist())) == len(runs)


def test_patterned_words_keep_their_ids(spark):
    from tokenizers import Tokenizer

    texts = [thue_morse(n) + " " + thue_morse(n, "b", "a") for n in (1024, 2048)] + [thue_morse(1024, "b", "a")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tok = Tokenizer.from_file(word_tokenizer())
    for r in packing.pack(docs, word_tokenizer(), with_ids=True).collect():
        assert r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that says little, the bytes decide."""
    monkeypatch.setattr(packing.Pieces, "hashes", lambda self, seed=0: (self.end - self.start).astype(np.uint64))
    coder = packing.WordTokenizer(word_tokenizer())
    data, offsets = utf8(pa.array(["abc xyz", "", "xyz the", "Some words here"]))
    ids, lengths = coder.encode(packing.Pieces(data, offsets))
    want = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in ("abc xyz", "", "xyz the", "Some words here")]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert zlib.crc32(ids.tobytes())


def test_windows_of_patterned_words_stay(spark):
    """Two windows that differ in such words alone are not equal."""
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    rest = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{a} {rest[:120]}"), (2, f"{b} {rest[:120]}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.dedup(docs).collect()] == [0, 0]


def test_many_equal_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", f"'{text}' AS text").union(spark.createDataFrame([(7, text + " tail")], "doc_id long, text string"))
    got = substring.dedup(docs).groupBy("n_words", "n_removed", "kept_text").count().collect()
    assert sorted(map(tuple, got)) == [(60, 60, "", 20_000), (61, 60, "tail", 1)]


def test_unique_windows_seldom_pass(spark, monkeypatch):
    """A sketch of one block would hold five anchors a cell here; the blocks grow in number instead."""
    monkeypatch.setattr(substring, "CELLS", 10)
    monkeypatch.setattr(substring, "BYTES_PER_BLOCK", 1 << 12)
    r = random.Random(3)
    texts = [" ".join(f"w{r.randint(0, 10**9)}" for _ in range(400)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kinds, _, _, size = substring.classes(docs)
    anchors = sum(len(substring._anchors(w)[0]) for w in [words_of(t) for t in texts])
    passed = substring.suspects(kinds, size).selectExpr("sum(size(anchors))").first()[0] or 0
    assert anchors > 5 * 1024 and passed < 0.1 * anchors
    assert {x.n_removed for x in substring.dedup(docs).collect()} == {0}
