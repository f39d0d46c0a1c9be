"""Spans of whole texts: the query against a plain reading of every window, held-out spans, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from platen.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.fitted()


def texts_with_spans(n, seed):
    """Texts and the labelled spans in them."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 8)):
            text += " ".join(pii._word(r) for _ in range(r.randint(2, 12))) + " "
            piece, kind = pii._entity(r)
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + r.choice((" ", ". ", ", ", "\n"))
        out.append((text, spans))
    return out


def test_recall_and_precision_beyond_the_base(model):
    held = texts_with_spans(300, 777)
    right = extra = lost = 0
    kinds = set()
    for (_, spans), (own, every) in zip(held, pii.spans_of(model, [t for t, _ in held])):
        new = [s for s in every if s not in own]
        want = [s for s in spans if not any(a < s[2] and s[0] < b for a, _, b in own)]
        right += sum(s in want for s in new)
        extra += sum(s not in want for s in new)
        lost += sum(s not in new for s in want)
        kinds |= {s[1] for s in new if s in want}
    assert right / (right + lost) > 0.88 and right / (right + extra) > 0.97 and kinds == {0, 1, 2, 3}


def test_skipped_windows_hold_nothing(model, spark, sf_dir):
    texts = [t for t, _ in texts_with_spans(40, 5)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    assert pii.tagged(model, texts, True) == pii.tagged(model, texts)


@pytest.mark.parametrize("section", [1 << 18, 600])
def test_query_against_plain_reading(spark, model, monkeypatch, section):
    """Base spans by the patterns, the tagger's by scoring all windows of a text at once."""
    monkeypatch.setattr(pii, "SECTION", section)
    texts = [t for t, _ in texts_with_spans(60, 9)] + [" ".join(t for t, _ in texts_with_spans(30, 10))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in pii.digests(docs).collect():
        t = texts[r.doc_id]
        own = pii.base(t)
        laid, starts = pii._laid([t])
        e = pii._scores(model, laid, pii._classes(laid), 0, len(laid), True)
        found: list = []
        for a, b in pii._stretches(e):
            pii._decoded(model, laid, a, e[a:b], found)
        found = [(a - int(starts[0]), k, b - int(starts[0])) for a, k, b in found]
        every = list(own)
        for s in found:
            if all(s[2] <= a or b <= s[0] for a, _, b in every):
                every.append(s)
        assert r.spans == pii._joined(sorted(every))
        assert r.base_sha256 == hashlib.sha256(pii._joined(own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in own) for k in range(4)]


def test_addresses_spelt_in_any_case(model):
    for text, spelt in (("write to a.very.long.name.of.somebody.who.works.there [at] example.org today", "a.very.long.name.of.somebody.who.works.there [at] example.org"), ("the mail anne [AT] webhost.org now", "anne [AT] webhost.org")):
        assert [text[a:b] for a, k, b in pii.spans_of(model, [text])[0][1]] == [spelt]


def test_odd_rows(spark):
    schema = "doc_id long, text string, spans string, n_email long"
    rows = [(1, "mail a.b@c.example.com", "x", 9), (1, "mail a.b@c.example.com", "x", 9), (None, None, None, None), (2, "", "", 0), (3, "word " * 60_000 + "+1 323 555 9830", "y", 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.n_email, r.n_phone, r.spans) for r in pii.find(df).collect()), key=repr)
    assert got == sorted([(1, 1, 0, "email:5:22")] * 2 + [(None, 0, 0, ""), (2, 0, 0, ""), (3, 0, 1, "phone:300000:300015")], key=repr)
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.where("text = 'mail [EMAIL]' AND n_email = 9").count() == 2 and clean.where("text IS NULL").count() == 1
    assert pii.find(df.where("false")).count() == pii.redact(df.where("false")).count() == 0


def test_weights_are_of_the_stated_size(model):
    assert sum(w.size for w in model.w.values()) < 25_000 and all(np.isfinite(w).all() for w in model.w.values())
