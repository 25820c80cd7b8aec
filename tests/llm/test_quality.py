import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from lavra.llm import boosting, discriminant, queries, statistics

LABELLED = "/root/testdata/sf0.1"


def test_counts_against_brute_force():
    rng = random.Random(2)
    parts = ["a", "b", "cc", " ", " ", "\n", "\n", "\t", "#", "|", "é", "日", "\x0b", "A."]
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(rng.randrange(8))]
        got = statistics.counts(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert tuple(got[c][i] for c in statistics.COUNTS[:5]) == brute.statistics(text)


def _parts(frame, good):
    apart = frame.where("held_out") if "held_out" in frame.columns else frame
    labels = frame.sparkSession.read.parquet(f"{LABELLED}/labels.parquet")
    rows = apart.join(labels, "doc_id").select("quality", good).collect()
    return [[r[1] for r in rows if r.quality == k] for k in (0, 1)]


def test_held_out_quality(spark):
    frame = queries.op2(spark, LABELLED)
    assert frame.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    bad, good = _parts(frame, "score")
    order = np.argsort(np.argsort(np.array(bad + good)))
    area = (order[len(bad) :].sum() - len(good) * (len(good) - 1) / 2) / (len(bad) * len(good))
    assert area > 0.99 and np.mean(np.array(good) >= 0.7) > 0.99 and np.mean(np.array(bad) >= 0.7) < 0.05


def test_rules_keep_good_documents(spark):
    frame = queries.op3(spark, LABELLED)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{LABELLED}/documents.parquet").where("doc_id % 9 = 0").collect()}
    for r in frame.where("doc_id % 9 = 0").collect():
        base = brute.statistics(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)
    bad, good = _parts(frame.where("NOT base_failed"), "kept")
    assert np.mean(good) > 0.995 and (not bad or np.mean(bad) < 0.1)


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(statistics.FEATURES)))
    at = statistics.FEATURES.index("symbols")
    y = (rng.random(4000) < 1 / (1 + np.exp(2 * x[:, at] - np.sin(3 * x[:, 0]) * 2))).astype(float)
    trees = boosting.train(x, y)
    assert trees.score(x)[y == 1].mean() > trees.score(x)[y == 0].mean() + 0.3
    for name, sign in boosting.MONOTONE.items():
        j = statistics.FEATURES.index(name)
        line = np.repeat(x[:40], 30, axis=0)
        line[:, j] = np.tile(np.linspace(-3, 3, 30), 40)
        steps = np.diff(trees.score(line).reshape(40, 30), axis=1)
        assert (steps * sign >= -1e-12).all()


def test_flat_nodes_against_recursion():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(statistics.FEATURES)))
    trees = boosting.train(x, (x[:, 0] + x[:, 3] > 0).astype(float))

    def walk(node, row):
        f = trees.feature[node]
        return trees.value[node] if f < 0 else walk(trees.left[node] if row[f] <= trees.threshold[node] else trees.right[node], row)

    want = [1 / (1 + np.exp(-trees.base - sum(walk(r, row) for r in trees.roots))) for row in x[:60]]
    assert np.allclose(trees.score(x[:60]), want)


def test_log_density_against_the_formula():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 3))
    cov = [a @ a.T + np.eye(3), np.diag([1.0, 2.0, 3.0])]
    means = rng.normal(size=(2, 3))
    factors = [np.linalg.cholesky(c) for c in cov]
    model = discriminant.Discriminant(means, np.array([np.linalg.inv(f) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]))
    x = rng.normal(size=(20, 3))
    density = [-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) - 0.5 * np.log(np.linalg.det(c)) for m, c in zip(means, cov)]
    assert np.allclose(model.log_ratio(x), density[1] - density[0])


def test_fitted_sums_against_numpy(spark):
    rng = np.random.default_rng(5)
    d = len(statistics.FEATURES)
    x, y = rng.normal(size=(600, d)), rng.integers(0, 2, 600)
    x[y == 1, 0] += 1
    frame = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)] + [(None, [0.0] * d), (7, [9.0] * d)], "quality int, features array<double>")
    model = discriminant.fit(frame.repartition(5))
    assert np.allclose(model.means, [x[y == k].mean(axis=0) for k in (0, 1)])
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).sum() for k, c in enumerate(own)) / len(y)
    shrunk = 0.6 * own[1] + 0.3 * pooled + 0.1 * np.diag(np.diag(pooled))
    assert np.allclose(np.linalg.inv(model.whiten[1].T @ model.whiten[1]), shrunk, atol=1e-6)


@pytest.mark.parametrize("module", [boosting, discriminant])
def test_no_labels_empty_and_clashing(spark, module):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 1_000_000), (3, "a b c")], "doc_id long, text string")
    rows = docs.withColumns({"s": F.lit(1), "score": F.lit(2)}).select("doc_id", statistics.measured("text").alias("s")).select("doc_id", "s.*")
    labelled = rows.withColumn("quality", F.lit(1))
    assert module.fit(labelled) is None and module.fit(labelled.limit(0)) is None
    scores = rows.select(module.scored(None, "features").alias("score")).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    both = rows.withColumn("quality", F.when(F.col("doc_id") == 3, 1).otherwise(0))
    model = module.fit(both)
    assert all(0 <= r.score <= 1 for r in rows.select(module.scored(model, "features").alias("score")).collect())
    assert rows.limit(0).select(module.scored(model, "features")).count() == 0
