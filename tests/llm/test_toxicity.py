"""The classifier on labels that it never saw, and its rules."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.cases import ODD, empty, frame, prose
from tidemark.llm import toxicity as t

INSULTS = ["blighter", "nincompoop", "scoundrel", "Dummkopf"]


def corpus(seed, n=1_500):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randrange(5, 80)).split(), i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                word = rng.choice(INSULTS) + rng.choice(["", "", ",", "en"])
                words.insert(rng.randrange(len(words)), rng.choice([str, str.upper, str.title])(word))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1)
    docs, marked = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, quality string")
    got = {r.doc_id: r for r in t.toxicity(docs, t.train(docs, marked)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got.values() if r.held_out]
    toxic = [r.predicted for r in held if r.doc_id % 8 == 0]
    clean = [r.predicted for r in held if r.doc_id % 8]
    assert sum(toxic) >= 0.95 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(2, 600)
    docs = frame(spark, rows)
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x, q) for i, x, q in labels]
    models = [t.train(docs, spark.createDataFrame(x, "doc_id long, toxic int, quality string")) for x in (labels, flipped)]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()


def test_odd_rows_and_no_labels(spark):
    rows, labels = corpus(3, 400)
    docs, marked = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality string")
    model = t.train(docs, marked)
    got = t.toxicity(frame(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] == scores[3] < 0.7
    assert t.toxicity(empty(spark), model).count() == 0
    nothing = t.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.7 for r in t.toxicity(frame(spark, ODD), nothing).collect())


def test_drop_toxic_keeps_all_columns(spark):
    rows, labels = corpus(4, 600)
    docs = frame(spark, rows + [(-1, None)])
    model = t.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality string"))
    kept = t.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in t.toxicity(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == want and -1 in want


def test_features_of_long_texts_are_those_of_their_parts():
    text = ("Blighter é É " + "wörd " * 9).encode() * 40_000
    assert len(text) > 2 * t.STEP
    long_ = t.text_features([text])[1]
    short = t.text_features([("Blighter é É " + "wörd " * 9).encode()])[1]
    assert set(short.tolist()) == set(long_.tolist())
    rows, _ = t.text_features([b"", b"x", text, b"", b"y z"])
    assert set(rows.tolist()) == {1, 2, 4}


@pytest.mark.parametrize("prior", [0.1, 0.95])
def test_the_gradient_is_that_of_the_plain_risk(prior):
    rng = np.random.default_rng(3)
    k, n_p, n_u = 6, 30, 80
    x_p, x_u = rng.random((n_p, k)) < 0.4, rng.random((n_u, k)) < 0.2

    def risk(theta):
        """Positive and negative part, text by text."""
        margin = lambda x: theta[k] + sum(theta[j] for j in range(k) if x[j])
        loss = lambda m: float(np.log1p(np.exp(-m)))
        plus = prior * sum(loss(margin(x)) for x in x_p) / n_p
        return plus, sum(loss(-margin(x)) for x in x_u) / n_u - prior * sum(loss(-margin(x)) for x in x_p) / n_p

    seen = set()
    for _ in range(12):
        theta = rng.normal(size=k + 1) * 2
        g, negative = t.gradient(theta, (*np.nonzero(x_p), n_p), (*np.nonzero(x_u), n_u), prior)
        assert abs(negative - risk(theta)[1]) < 1e-9
        whole = (lambda th: sum(risk(th))) if negative >= 0 else (lambda th: -risk(th)[1])
        step = np.eye(k + 1) * 1e-6
        plain = [(whole(theta + step[j]) - whole(theta - step[j])) / 2e-6 for j in range(k + 1)]
        assert np.allclose(g, plain, atol=1e-6)
        seen.add(negative >= 0)
    assert True in seen and (prior < 0.5 or False in seen)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One id on very many rows does not fill the driver, and repeated rows count once."""
    seen = []
    monkeypatch.setattr(t, "fit", lambda p, u, prior: seen.append((len(p), len(u))))
    learnable = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(learnable[0], f"text {k}") for k in range(3_000)] + [(learnable[1], "one text")] * 3_000 + [(i, f"x {i}") for i in learnable]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in learnable], "doc_id long, toxic int")
    t.train(docs, labels, most_positive=50, most_unlabelled=70)
    t.train(docs.where(f"doc_id = {learnable[1]}"), labels)
    assert seen[0][0] <= 50 and seen[0][1] <= 70 and seen[1] == (2, 2)


def test_recall_on_the_shared_table(spark):
    """At sf0.1, with some 300 positives to learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = t.toxicity(docs, t.train(docs, labels)).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * (n.get((0, 1), 0) + n[0, 0])


def test_case_is_folded():
    a, b = (t.text_features([x.encode()])[1] for x in ("ÉCOLE Straße", "école straße"))
    assert (a == b).all()


def test_risk_is_not_let_below_zero():
    """Positives that the unlabelled text holds too stay positive; pure chance does not count."""
    rng = np.random.default_rng(1)
    make = lambda toxic: np.unique(np.concatenate([rng.integers(100, 5_000, 40), [7] if toxic else []]).astype(np.int64))
    positive, unlabelled = [make(True) for _ in range(200)], [make(i % 10 == 0) for i in range(2_000)]
    model = t.fit(positive, unlabelled, 0.1)
    assert 7 in model.buckets
    place = int(np.flatnonzero(model.buckets == 7)[0])
    assert 1 / (1 + np.exp(-(model.weights[place] + model.bias))) > 0.7
    assert 1 / (1 + np.exp(-model.bias)) < 0.3
