"""The training-data operators: odd inputs, brute force, round trips, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platen.llm import chat, classifier, embed, html, mixing, packing, pii, quality_rules, simhash, substring
from platen.llm.common import Forest, Words, components, rolled, sliding
from platen.llm.queries import QUERIES, word_tokenizer
from platen.llm.sql import ORACLES

from ..conftest import rows_of

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
PROSE = "the cat sat on a mat and the dog was not in it but they had all of that to see for the rest of this day " * 3
#: Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash with the operators' own.
ODD = [
    (1, PROSE, "en", "src0", 1, "a", 1),
    (1, PROSE, "en", "src0", 1, "a", 1),
    (1, "another text under the same id", None, "src0", 2, None, 2),
    (2, None, "en", None, None, "b", None),
    (3, "", "en", "src1", 0, "c", 0),
    (4, " \n\t ", None, None, 4, "d", 0),
    (None, PROSE, "de", "src0", 5, None, 3),
    (None, None, None, None, None, None, None),
    (5, LONG, "en", "src2", 6, "e", 9),
    (6, "one", "fr", "src1", 7, "f", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, None), (6, None, 1), (None, 1, 0), (1, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")


def per_row(name, odd, none, labels):
    run = {
        "quality": quality_rules.quality,
        "substring": substring.dedup_digests,
        "simhash": simhash.near_duplicates,
        "classifier": lambda d: classifier.classify(d, labels),
        "mixing": mixing.decide,
        "pii": pii.digests,
    }[name]
    return run(odd), run(none)


@pytest.mark.parametrize("name", ["quality", "substring", "simhash", "classifier", "mixing", "pii"])
def test_one_row_for_each_odd_row_and_none_for_none(odd, none, labels, name):
    got, empty = per_row(name, odd, none, labels)
    assert sorted(r.doc_id or 0 for r in got.collect()) == sorted(r[0] or 0 for r in ODD)
    assert empty.count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_against_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


# --- shared pieces ---------------------------------------------------------------------------------


def test_words_and_windows():
    texts = ["a bb\x0bccc", "", "  ", "x", "é\x85y z"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    w = Words(np.frombuffer(data, np.uint8), offsets)
    assert w.count.tolist() == [len(t.encode().split()) for t in texts]
    assert len({*w.hash.tolist()}) == len({*data[: offsets[1]].split(), b"x", *"é\x85y z".encode().split()})
    # anagrams differ
    a = Words(np.frombuffer(b"abc cab", np.uint8), np.array([0, 7])).hash
    assert a[0] != a[1]
    h = np.arange(1, 80, dtype=np.uint64)
    assert len(rolled(h, 35, 7)) == 45 and len(set(rolled(h, 35, 7).tolist())) == 45
    assert (rolled(np.tile(h[:40], 2), 35, 7)[:5] == rolled(np.tile(h[:40], 2), 35, 7)[40:45]).all()
    assert sliding(h, 28, np.minimum).tolist() == h[:52].tolist()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (9, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = [set(range(61)), set(range(100, 150)), {200, 201, 202}]
    assert set(got) == set.union(*groups)
    assert all(len({got[x] for x in g}) == 1 for g in groups) and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans():
    f = Forest(100)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 100, 300), rng.integers(0, 100, 300)
    for i in range(0, 300, 50):
        f.link(a[i : i + 50], b[i : i + 50])
    assert len(f.edges) == 100 - len(set(f.label.tolist()))
    assert (f.label[a] == f.label[b]).all()


# --- 1 quality ----------------------------------------------------------------------------------------


def test_quality_counts(spark):
    text = "a b c d e f g h i # a b c d e f g h\nx y\nx y\n \n"
    r = quality_rules.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (22, 1, 1, 16)
    assert r.base_failed and not r.kept


def test_quality_keeps_rows_whole(odd):
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in quality_rules.quality(odd).where("kept").collect())


# --- 2 substrings -------------------------------------------------------------------------------------


def brute_removed(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((i, p))
    dead = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                dead[i].update(range(p, p + 35))
    return [(len(w), len(d), b" ".join(x for j, x in enumerate(w) if j not in d).decode()) for w, d in zip(words, dead)]


@pytest.mark.parametrize("grouped", [1 << 17, 50])
def test_repeated_passages_go(spark, monkeypatch, grouped):
    monkeypatch.setattr(substring, "GROUPED", grouped)
    r = random.Random(4)
    word = lambda: r.choice("abcdefghij") * r.randint(1, 4) + str(r.randint(0, 40))
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(r.randint(0, 50))] + (passage[r.randint(0, 10) : r.randint(40, 60)] if r.random() < 0.6 else []) + [word() for _ in range(r.randint(0, 50))]) for _ in range(60)]
    texts += ["z " * 100, "z " * 36, "z " * 35, "", None, texts[0], texts[0], LONG, " ".join(passage[:34])]
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted(((r.n_words, r.n_removed, r.kept_text) for r in substring.dedup(docs).collect()))
    assert got == sorted(brute_removed(texts))
    digests = sorted(r.kept_sha256 for r in substring.dedup_digests(docs).collect())
    assert digests == sorted(hashlib.sha256(x[2].encode()).hexdigest() for x in got)


# --- 3 chat -------------------------------------------------------------------------------------------


def test_transcript_roles_and_markers(spark):
    text = "System: be brief\n\nUser: what is it?\nmore of it\n\nAssistant: it is that\n\nNote: a remark\n"
    rows = spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, " \n "), (None, 0, "Human: hello there?")], "conv_id long, turn long, text string")
    got = [(r.conv_id, r.role, r.text) for r in chat.parse(rows).orderBy("conv_id", "turn").collect()]
    assert got[:3] == [(None, "user", "hello there?"), (1, "system", "be brief"), (1, "user", "what is it?\nmore of it")]
    assert got[3][:2] == (1, "assistant") and not [g for g in got if g[0] in (2, 3)]


def test_segments_decode_as_one(spark, monkeypatch):
    r = random.Random(6)
    lines = [r.choice(["User: ", "Assistant: ", "", "", "Bob: "]) + "x" * r.randint(1, 300) + r.choice(["", "?"]) if r.random() < 0.8 else "" for _ in range(400)]
    want = [chat.ROLES[s % 3] for s in chat.decode(lines) if s < 3]
    monkeypatch.setattr(chat, "SEGMENT", 7)
    rows = spark.createDataFrame([(1, i, "\n".join(lines[i : i + 5])) for i in range(0, 400, 5)], "conv_id long, turn long, text string").repartition(5)
    got = [t.role for t in chat.parse(rows).where("piece = 0").orderBy("turn").collect()]
    assert got == want


# --- 4 classifier -------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    docs, marks = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = classifier.classify(docs, marks).join(marks, "doc_id").toPandas()
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)) == got.held_out).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_without_labels_every_score_is_a_half(odd, labels):
    assert {r.score for r in classifier.classify(odd, labels.where("false")).collect()} == {0.5}


# --- 5 SimHash ----------------------------------------------------------------------------------------


def test_fingerprints_bit_by_bit(spark):
    texts = ["A b C d e", "one two", "", None, "x " * 50, PROSE]
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert got[i] & (2**64 - 1) == want


@pytest.mark.parametrize(("hot", "broadcast"), [(20_000, 0), (10, 0), (20_000, 1 << 21)])
def test_links_of_fingerprints_are_whole(spark, hot, broadcast):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = {int(c) for c in centres} | {0}
    for c in centres[:25]:
        x = int(c)
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            points.add(x)
    p = np.array(sorted(points), np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 4
    lab = np.arange(len(p))
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(p))])
        if (new == lab).all():
            break
        lab = new
    distinct = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components(simhash.links(distinct, 4, hot, broadcast)).collect()}
    ids = [root.get(int(x), int(x)) for x in p.view(np.int64)]
    assert len(set(zip(ids, lab.tolist()))) == len(set(ids)) == len(set(lab.tolist()))


def test_groups_of_documents_end_to_end(spark):
    """Every document's fingerprint and component by brute force over all pairs."""
    r = random.Random(8)
    texts = []
    for _ in range(40):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(0, 400))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                if copy:
                    copy[r.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    texts += [None, "", texts[3], texts[3].upper()]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    prints = [simhash.fingerprint_of((t or "").lower().encode().split(), 4) for t in texts]
    label = list(range(len(texts)))
    while True:
        new = [max(label[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
        if new == label:
            break
        label = new
    got = {x.doc_id: (x.fingerprint & (2**64 - 1), x.component_id) for x in simhash.near_duplicates(docs, 4, 4).collect()}
    assert got == {1000 - i: (prints[i], 1000 - label[i]) for i in range(len(texts))} and len(set(label)) < len(texts) - 20


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(5)
    p = np.unique(rng.integers(0, 2**16, 3000, dtype=np.uint64))
    q, d = p[:50], 3
    got = {(int(a), int(b)) for x, y in simhash.BKTree(p).search(q, d) for a, b in zip(x, y)}
    want = set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(q[:, None] ^ p[None, :]) <= d))))
    assert got == want


def test_one_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    groups = simhash.near_duplicates(odd).select("fingerprint").distinct().count()
    assert kept.count() <= groups and kept.where("doc_id = 5").count() == 1
    assert kept.where(F.col("text") == PROSE).count() == 1


# --- 6 embeddings -------------------------------------------------------------------------------------


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 64))
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 64)) * 0.2, np.repeat(x[:3], 20, 0), x[5] + rng.normal(size=(150, 64)) * 0.1]).astype(np.float32)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000 + i, v, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in embed.near_duplicates(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found, all_links = sum(got[i].n_links for i in range(len(x))), near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert found >= 0.9 * all_links > 0
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(6))
    assert got[1006].n_links == got[1007].n_links == 1 and got[1007].component_id == 1006 and not got[1007].kept
    assert embed.near_duplicates(df.where("false")).count() == 0


# --- 7 mixing -----------------------------------------------------------------------------------------


def test_raked_margins_hold(spark):
    rng = np.random.default_rng(1)
    cells = [(s, lang, t, int(rng.integers(1, 1000))) for s in "abc" for lang in "xy" for t in "pq"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": [("a", 0.2), ("b", 0.3), ("c", 0.5)], "lang": [("x", 0.6), ("y", 0.4)], "topic": [("p", 0.5), ("q", 0.5)]}
    raked = mixing.rake(df, {m: spark.createDataFrame(t, f"{m} string, target double") for m, t in targets.items()})
    for m, t in targets.items():
        got = {r[m]: r.w for r in raked.groupBy(m).agg(F.sum("weight").alias("w")).collect()}
        assert all(abs(got[k] - v) < 1e-4 for k, v in t)
    # The sample's expected margins are the targets, and no chance exceeds 1, whatever is to be kept.
    for keep in (0.05, 0.4, 1.0):
        table = mixing.chances(raked, keep)
        assert table.where("chance < 0 OR chance > 1").count() == 0
        for r in mixing.margins(table).collect():
            assert abs(r.expected - r.target) < 1e-9 and abs(r.target - dict(targets[r.margin])[r.value]) < 1e-4
    kept = mixing.chances(raked, 0.05).agg(F.sum(F.col("chance") * F.col("share"))).first()[0]
    assert abs(kept - 0.05) < 1e-9


def test_default_targets_are_met_and_keep_enough(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    base = mixing.base_of(docs)
    base = base.withColumn("topic", mixing.topic(mixing.spread_of(base)))
    table = mixing.fitted(base)
    got = table.agg(F.sum(F.col("chance") * F.col("share")), F.max("chance")).first()
    assert abs(got[0] - mixing.KEEP) < 1e-9 and got[1] <= 1
    rows = mixing.margins(table).collect()
    assert all(abs(r.expected - r.target) < 1e-9 for r in rows) and any(abs(r.target - r.observed) > 1e-4 for r in rows)
    assert len({r.value for r in rows if r.margin == "topic"}) >= 4


def test_repeats_hold_the_tempered_targets_in_full(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = mixing.decide(docs, repeat=True).collect()
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens * r.chance for r in rows) / total - mixing.KEEP) < 1e-9 and max(r.copies for r in rows) > 1
    for m in mixing.MARGINS:
        held, expected = {}, {}
        for r in rows:
            held[r[m]] = held.get(r[m], 0) + r.tokens
            expected[r[m]] = expected.get(r[m], 0) + r.tokens * r.chance / total / mixing.KEEP
        raised = {k: n**mixing.TEMPER for k, n in held.items() if n}
        assert all(abs(expected[k] - n / sum(raised.values())) < 1e-9 for k, n in raised.items()), m
    assert all(r.kept == (r.copies > 0) and abs(r.copies - r.chance) < 1 for r in rows)
    kept = mixing.keep_rows(docs, repeat=True)
    assert kept.columns == docs.columns
    assert {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in rows if r.copies}
    # Without, a row is kept once or not.
    assert all(r.copies == int(r.kept) and r.chance <= 1 for r in mixing.decide(docs).collect())


def test_given_topics_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "en", f"t{i % 2}", 1, "x", "y") for i in range(50)], "doc_id long, text string, source string, lang string, topic string, kept int, row string, draw string")
    got = mixing.decide(docs, topic="topic").collect()
    assert {r.topic for r in got} == {"t0", "t1"} and len(got) == 50
    kept = mixing.keep_rows(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= 50 and {r.kept for r in kept.collect()} == {1}
    assert mixing.keep_rows(docs.where("false")).count() == 0


# --- 8 HTML -------------------------------------------------------------------------------------------

PAGES = {
    "<article><h1>T &amp; U</h1><p>One<p>Two  <b>three</b></article><footer>&copy; me</footer>": "T & U\nOne\nTwo three",
    "": "",
    "plain words only": "plain words only",
    "<div class=sidebar>x y</div><div class=content><p>A sentence of some words here.</p><ul><li>i<li>j</ul></div>": "A sentence of some words here.\ni\nj",
    "<script>if (a<b) '</p>'</script><p>Kept text.</p><style>p{}</style><!-- <p>no</p> --><form><p>Your name</p></form>": "Kept text.",
    "<main><p>Body of it.</p><section class='comments'><article><p>A reader says a long thing about this article here.</p></article></section></main>": "Body of it.",
    "<div class='page-with-sidebar'><article><p>Inside the wrapper.</p></article></div><nav><a href=x>Home</a></nav>": "Inside the wrapper.",
    "<article><p>Cut off in the mid": "Cut off in the mid",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def test_min_cut_against_brute_force():
    r = random.Random(9)
    for _ in range(60):
        n = r.randint(1, 8)
        costs = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1)) for i in range(n) for j in range(i) if r.random() < 0.5]

        def energy(lab):
            return sum(-c if not x and c < 0 else 0 for x, c in zip(lab, costs)) * 0 + sum((c if not x else 0) if c > 0 else (-c if x else 0) for x, c in zip(lab, costs)) + sum(w for a, b, w in edges if lab[a] != lab[b])

        best = min(energy([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert abs(energy(html.min_cut(costs, edges)) - best) < 1e-9


def test_pages_query(spark):
    rows = spark.createDataFrame([(1, "u", next(iter(PAGES))), (None, None, None), (2, "v", "<p>x</p>" * 5000)], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.n_chars) for r in html.extract(rows).collect()}
    assert got == {1: ("u", 19), None: (None, 0), 2: ("v", 9999)}
    assert html.extract(rows.where("false")).count() == 0


# --- 9 packing ----------------------------------------------------------------------------------------


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_tokenizer())
    packed = packing.pack(odd, word_tokenizer(), capacity=64, with_ids=True).cache()
    rows = packed.collect()
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted(tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in ODD)
    total = sum(map(len, want))
    assert sum(r.length for r in rows) == total and len(by_sequence) <= -(-total // 64) + 2
    longest = max(want, key=len)
    pieces = sorted((r.start, r.ids) for r in rows if r.doc_id == 5)
    assert [i for _, ids in pieces for i in ids] == list(longest)
    assert packing.texts_of(packed).count() == len(by_sequence)
    assert packing.pack(odd.where("false"), word_tokenizer()).count() == 0


def test_words_encode_as_whole_texts_do():
    from tokenizers import Tokenizer

    r = random.Random(3)
    alphabet = list("hHtabcXYZ019'’.,!?<|>=_- \t\n\x0b\x85 éÉßİΣςσ中👍̸̱́​\x01@#") + ["<|endoftext|>", "'s", "'LL"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, lengths = packing.WordTokenizer(word_tokenizer()).encode(packing.Pieces(np.frombuffer(data, np.uint8), offsets))
    got = [x.tolist()[:-1] for x in np.split(ids, np.cumsum(lengths)[:-1])]
    want = [e.ids for e in Tokenizer.from_file(word_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_plan_is_tight_and_pairs_large_pieces():
    r = random.Random(1)
    lengths = {size: r.randint(0, 30) for size in range(1, 4097)}
    slots = packing.plan(lengths)
    fill, large = {}, {}
    for size, _, n, first, _ in slots:
        for k in range(n):
            fill[first + k] = fill.get(first + k, 0) + size
            large[first + k] = large.get(first + k, 0) + (3 * size > 4096)
    total = sum(k * v for k, v in lengths.items())
    assert max(fill.values()) <= 4096 and max(large.values()) <= 2 and len(fill) <= 1.01 * total / 4096 + 1


# --- 10 personal data ---------------------------------------------------------------------------------


def test_base_patterns_by_brute_force():
    import re

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"\D", "", m[0])
            if 12 <= len(d) <= 19 and pii._luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        return sorted(out)

    r = random.Random(2)
    for _ in range(8000):
        t = "".join(r.choice("0123456789012345....@@+-() abc%_é\n") for _ in range(r.randint(0, 70)))
        assert pii.base(t) == brute(t)


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 150_000):
        pii.base(t)


def test_gradients():
    m = pii.Tagger({k: v.astype(np.float64) for k, v in pii.Tagger.fresh().w.items()})
    x, y = pii.labelled(3, 1)
    _, grads = m.gradients(x, y)
    for k, g in grads.items():
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        old, loss = m.w[k][at], []
        for step in (1e-4, -1e-4):
            m.w[k][at] = old + step
            loss.append(m.gradients(x, y)[0])
        m.w[k][at] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_tagger_on_held_out_spans():
    model = pii.train()
    x, y = pii.labelled(300, 1234)
    got = np.array([model.decode(e) for e in model.emissions(x)])
    assert (got == y).mean() > 0.97 and (got == y)[y > 0].mean() > 0.9
    assert pii.spans_of(model, ["ring (323) 555-9830 now"])[0][1] == [(5, 3, 19)]
    assert pii.spans_of(model, ["GNU License, version 3.0, 12,500 words"])[0] == ([], [])


def test_redaction(odd, spark):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    text = "é mail ann.b@x.example.com or +1 (323) 555-9830."
    got = pii.redact(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["é mail [EMAIL] or [PHONE].", None]
