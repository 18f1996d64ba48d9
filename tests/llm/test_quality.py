import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa

from ticketlens.llm.quality import Chain, fit, line_features, op3_quality, scored, scores

SF = "/root/testdata/sf0.01"


def test_marginals_and_gradient_equal_enumeration():
    rng = np.random.default_rng(1)
    counts, width = np.array([3, 1, 5]), 4
    features = rng.normal(size=(counts.sum(), width))
    model = Chain(rng.normal(size=width), rng.normal(size=(2, 2)))
    ends = np.cumsum(counts)

    def log_z_and_marginals(m):
        zs, good = [], []
        for e, n in zip(ends, counts, strict=True):
            u = features[e - n : e] @ m.line
            w = {y: sum((1 if y[i] else -1) * u[i] / 2 for i in range(n)) + sum(m.link[a, b] for a, b in zip(y, y[1:], strict=False)) for y in product((0, 1), repeat=n)}
            z = np.logaddexp.reduce(list(w.values()))
            zs.append(z)
            good += [sum(np.exp(v - z) for y, v in w.items() if y[i]) for i in range(n)]
        return np.array(zs), np.array(good)

    assert np.allclose(model.good(features, counts), log_z_and_marginals(model)[1])
    labels = np.array([1, 0, 1])

    def likelihood(m):
        gold = [sum((1 if y else -1) * x / 2 for x in features[e - n : e] @ m.line) + (n - 1) * m.link[y, y] for e, n, y in zip(ends, counts, labels, strict=True)]
        return ((np.array(gold) - log_z_and_marginals(m)[0]) / counts).sum()

    line, link = model.gradient(features, counts, labels)
    for i in range(width):
        step = np.zeros(width)
        step[i] = 1e-6
        assert abs((likelihood(Chain(model.line + step, model.link)) - likelihood(Chain(model.line - step, model.link))) / 2e-6 - line[i]) < 1e-4
    for a, b in product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-6
        assert abs((likelihood(Chain(model.line, model.link + step)) - likelihood(Chain(model.line, model.link - step))) / 2e-6 - link[a, b]) < 1e-4


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op3_quality(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    right = sum(p == y for p, y in tested)
    bad = [p for p, y in tested if y == 0]
    assert right / len(tested) >= 0.95 and bad.count(0) / len(bad) >= 0.8


def test_scores_do_not_depend_on_the_batch(spark):
    rng = random.Random(2)
    texts = ["", None, "\n\n", "One line."] + ["\n".join(" ".join(rng.choices(["word", "###", "THE", "é,"], k=6)) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    model = Chain(np.linspace(-1, 1, line_features(pa.array([""]))[0].shape[1]), np.array([[1.0, -1], [-1, 1]]))
    whole = scores(model, pa.array(texts))
    assert np.allclose(whole, [scores(model, pa.array([t], pa.string()))[0] for t in texts])
    assert np.allclose(whole, scores(model, pa.array(texts), cells=10))


def test_rows_without_labels(spark):
    docs = spark.createDataFrame([(None, "a", "x"), (1, None, "x"), (1, "b", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in scored(docs, fit(docs, labels)).collect()] == [0.5] * 3
    assert scored(docs.limit(0), fit(docs, labels)).count() == 0
