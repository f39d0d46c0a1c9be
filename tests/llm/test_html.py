"""The cut of a page: brute force over labels, held-out pages, pages without names, odd rows."""

import itertools
import random
import re

import pytest

from platen.llm import html, html_model


@pytest.fixture(scope="module")
def model():
    return html_model.train()


def brute_text(page, model):
    """The text of the labelling of least energy, by trying all."""
    blocks = html.blocks_of(page)
    own, around, parts, place = html.costs_of(model, blocks)
    costs, n = own + around, len(own)
    edges = [(i, n + k, html.HOLD) for i, k in enumerate(place)] + [(n + k, n + p.parent, html.NEST) for k, p in enumerate(parts) if p.parent >= 0]
    edges += [(i - 1, i, html.NEAR if place[i - 1] == place[i] else html.FAR) for i in range(1, n)]
    best = min(itertools.product((False, True), repeat=len(costs)), key=lambda lab: sum(-c for x, c in zip(lab, costs) if x) + sum(w for a, b, w in edges if lab[a] != lab[b]))
    return "\n".join(b.text for b, good in zip(blocks, best) if good)


def test_query_against_all_labellings(spark, model):
    r = random.Random(4)
    found = []
    while len(found) < 25:
        page, _ = html_model.pages(1, r.randint(10**6, 10**7))[0]
        blocks = html.blocks_of(page)
        if 0 < len(blocks) + len(html.parts_of(blocks)[0]) <= 13:
            found.append(page)
    rows = spark.createDataFrame([(i, "u", p) for i, p in enumerate(found)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.extract(rows).collect()}
    assert got == {i: brute_text(p, model) for i, p in enumerate(found)}


def f1(pairs):
    tp = sum(len(b.text) for b, y, g in pairs if y and g)
    return 2 * tp / (sum(len(b.text) for b, y, _ in pairs if y) + sum(len(b.text) for b, _, g in pairs if g))


def test_cut_beats_blocks_alone_on_held_out_pages(model):
    cut, alone = [], []
    for page, labels in html_model.pages(200, 31):
        blocks = html.blocks_of(page)
        cut += zip(blocks, labels, html.label(model, blocks))
        alone += zip(blocks, labels, [c > 0 for c in html.costs_of(model, blocks)[0]])
    assert f1(cut) > 0.96 and f1(cut) > f1(alone) + 0.1


def in_article(e):
    while e is not None:
        if e.tag == "article":
            return True
        e = e.parent
    return False


def test_given_pages_with_and_without_names(spark, sf_dir, model):
    kept = {"as they are": [], "without names": []}
    changed = 0
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").collect():
        truth = [in_article(b.parent) for b in html.blocks_of(r.html)]
        for k in kept:
            blocks = html.blocks_of(r.html if k == "as they are" else re.sub(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", r.html))
            got = html.label(model, blocks)
            kept[k] += zip(blocks, truth, got)
            changed += sum((c > 0) != g for c, g in zip(html.costs_of(model, blocks)[0], got))
    assert f1(kept["as they are"]) > 0.999 and f1(kept["without names"]) > 0.99 and changed > 100


def test_odd_rows(spark):
    page = "<article><h1>A title here</h1><p>Some words of a text, and more of them.</p></article>"
    deep = "<div>" * 50_000 + "<p>Deep down there is a sentence.</p>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "v", "", "y"), (3, None, deep, "z"), (4, "w", "<p>A sentence of words.</p>" * 20_000, "z"), (5, "w", "<nav><a href=x>Home</a></nav>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
    text = "A title here\nSome words of a text, and more of them."
    assert [g for g in got if g[0] == 1] == [(1, "u", text, len(text))] * 2
    by = {g[0]: g[2] for g in got}
    assert by[None] == by[2] == by[5] == "" and by[3] == "Deep down there is a sentence." and by[4].count("\n") == 19_999
    assert html.extract(df.where("false")).count() == 0


def test_inline_mathematics_stays(model):
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> and <object>its fallback</object> stay in this text.</p></article>"
    assert html.main_text(page, model) == "The sum a+b and its fallback stay in this text."
