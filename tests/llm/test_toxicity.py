import math
import random
import zlib

import numpy as np

from tarnlake.llm import toxicity


def make(n, seed=0):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    docs, labels = [], []
    for d in range(n):
        bad = rnd.random() < 0.15
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 60))]
        if bad:
            for _ in range(4):
                text.insert(rnd.randrange(len(text)), rnd.choice(["grimble", "snarf", "vextor", "qualmish"]))
        docs.append((d, " ".join(text)))
        if rnd.random() < 0.5:
            labels.append((d, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make(2500)
    truth = dict(labels)
    rows = toxicity.toxicity_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs)
    wrong = seen = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in truth:
            seen += 1
            wrong += r.predicted != truth[r.doc_id]
    assert seen > 200 and wrong <= 0.03 * seen


def test_held_out_labels_are_not_learned(spark):
    docs, labels = make(400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (toxicity.train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (None, "a b", None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(docs, none).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1 and all(r.predicted == 0 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    model = toxicity.train(docs.drop("score"), none)
    assert toxicity.drop_toxic(docs, none).columns == docs.columns
    assert toxicity.score_documents(docs, model, "s").count() == 4
    assert toxicity.toxicity_report(docs.limit(0), none).count() == 0


def test_repeated_rows_leave_room_for_unlabelled(spark):
    """Rows that stand in the table many times neither push the unlabelled side out nor change the model."""
    docs, labels = make(400)
    one, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    many = spark.createDataFrame(docs * 8, one.schema)
    bounds = toxicity.Bounds(positives=20, unlabelled=60)
    want = toxicity.train(one, known, bounds)
    assert want.weights and toxicity.train(many, known, bounds) == want


def test_negative_part_is_held_at_zero():
    z = np.array([5.0, 6.0])
    assert toxicity.nonnegative_risk(z, np.array([-9.0] * 50), 0.5)[1] < 0
    rng = np.random.default_rng(0)
    x_p, x_u = (rng.random((20, 200)) < 0.5).astype(np.float32), (rng.random((20, 200)) < 0.5).astype(np.float32)
    w, b = toxicity.fit(x_p, x_u, 0.3, decay=0)
    assert toxicity.nonnegative_risk(x_p @ w + b, x_u @ w + b, 0.3)[1] > -0.3


def plain_risk(x_p, x_u, w, b, prior):
    """(positive part, negative part) of the risk, one example at a time."""
    loss = lambda z: math.log(1 + math.exp(-z))
    g = lambda x: sum(a * c for a, c in zip(x, w, strict=True)) + b
    mean = lambda xs, sign: sum(loss(sign * g(x)) for x in xs) / len(xs)
    return prior * mean(x_p, 1), mean(x_u, -1) - prior * mean(x_p, -1)


def test_fit_equals_a_plain_reference():
    """Steps along numeric gradients of the same risk, where its negative part is above and below zero.

    The bias starts where its gradient is zero, so that rounding decides its first steps: hence the tolerance."""
    rng = np.random.default_rng(4)
    signs = set()
    for prior, flip in ((0.2, 0), (0.8, 1)):
        x_p, x_u = (rng.random((6, 3)) < 0.5).astype(np.float32), (rng.random((9, 3)) < 0.5).astype(np.float32)
        if flip:
            x_u = np.zeros_like(x_u)
        theta = np.array([0.0, 0.0, 0.0, math.log(prior / (1 - prior))])
        m, v = np.zeros(4), np.zeros(4)
        decay, rate, eps = 3e-4, 0.05, 1e-5

        def objective(t):
            positive, negative = plain_risk(x_p, x_u, t[:3], t[3], prior)
            return positive + negative if below >= 0 else -negative

        for step in range(1, 121):
            below = plain_risk(x_p, x_u, theta[:3], theta[3], prior)[1]
            signs.add(below >= 0)
            grad = np.array([(objective(theta + eps * e) - objective(theta - eps * e)) / (2 * eps) for e in np.eye(4)])
            grad[:3] += decay * theta[:3]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = toxicity.fit(x_p, x_u, prior, steps=120)
        assert np.allclose([*w, b], theta, atol=0.05), (w, b, theta)
    assert signs == {True, False}


def test_held_out_accuracy_on_labels(spark, sf):
    """Labelled documents of the part that is never learned from."""
    big = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out(docs["doc_id"]))
    score = toxicity.Scorer(model).score
    pairs = [(r.toxic, score(r.text or "") >= toxicity.THRESHOLD) for r in known.select("toxic", "text").collect()]
    hits = sum(t == 1 and p for t, p in pairs)
    assert sum(t for t, _ in pairs) >= 100
    assert hits / sum(t for t, _ in pairs) >= 0.9
    assert hits / sum(p for _, p in pairs) >= 0.7


def test_sample_is_bounded_by_bytes_not_by_length(spark):
    rows = [(k, f"t{k} " * (20_000 if k % 3 == 0 else 2)) for k in range(60)] + [(60, None), (61, "x" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = docs.select("doc_id")
    got = toxicity.sample_texts(docs, chosen, 1000, 400_000)
    assert sum(len(t) for t in got) <= 400_000 and any(len(t) > 50_000 for t in got) and "x" * 500_000 not in got
    assert len(toxicity.sample_texts(docs, chosen, 1000, 10**8)) == 61
    assert len(toxicity.sample_texts(docs, chosen, 7, 10**8)) <= 7
    assert toxicity.sample_texts(docs.limit(0), chosen, 7, 10**8) == []
