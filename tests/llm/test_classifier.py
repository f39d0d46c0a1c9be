"""The classifier against plain follow-the-regularised-leader and plain dot products, and on odd labels."""

import math
import random

import numpy as np
import pyarrow as pa

from platen.llm import classifier
from platen.llm.common import Words, utf8


def plain_fit(rows, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
    """FTRL-proximal by dictionaries, a feature at a time; the bias is a feature without regularisation."""
    z, n, zb, nb, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for features, y in rows:
            p = 1 / (1 + math.exp(-(bias + sum(v * weight(k) for k, v in features.items()))))
            old = {k: weight(k) for k in features}
            for k, v in features.items():
                g = (p - y) * v
                grown = n.get(k, 0.0) + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(grown) - math.sqrt(n.get(k, 0.0))) / alpha * old[k]
                n[k] = grown
            grown = nb + (p - y) ** 2
            zb += (p - y) - (math.sqrt(grown) - math.sqrt(nb)) / alpha * bias
            nb = grown
            bias = -zb / ((beta + math.sqrt(nb)) / alpha)
    return {k: weight(k) for k in z}, bias


def words_of(texts):
    return Words(*utf8(pa.array(texts)))


def some_texts(n):
    r = random.Random(2)
    return [" ".join(r.choice(("good", "words", "in", "Here", "###", "42", "spam!!", "spam!!")) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_fit_and_scores_against_plain_ones():
    texts = some_texts(60)
    words = words_of(texts)
    found = classifier.sparse(words)
    labels = [int("spam!! spam!!" not in t) for t in texts]
    model = classifier.fit([(c, v, y) for (c, v), y in zip(found, labels)])
    want, bias = plain_fit([(dict(zip(c.tolist(), v.tolist())), y) for (c, v), y in zip(found, labels)])
    assert abs(model.bias - bias) < 1e-6
    assert all(abs(model.weights[k] - w) < 1e-5 for k, w in want.items()) and np.count_nonzero(model.weights) == sum(w != 0 for w in want.values())
    for score, (c, v) in zip(model.scores(words), found):
        assert abs(score - 1 / (1 + math.exp(-(bias + sum(x * want[k] for k, x in zip(c.tolist(), v.tolist())))))) < 1e-5


def test_query_scores_are_the_models(spark):
    texts = some_texts(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, int("spam!!" not in t), None) for i, t in enumerate(texts)] + [(3, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = classifier.fit(classifier.sample_rows(docs, marks))
    want = model.scores(words_of(texts))
    got = {r.doc_id: r for r in classifier.classify(docs, marks).collect()}
    assert all(abs(got[i].score - want[i]) < 1e-9 and got[i].predicted == int(want[i] >= 0.3) for i in range(len(texts)))
    assert classifier.classify(docs.where("false"), marks).count() == 0
