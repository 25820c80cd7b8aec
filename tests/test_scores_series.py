import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lavra.operators import reports, scores, series
from lavra.sources import metric_logs

NAMES = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]


def _spans(tags):
    """Reading of a BIO sequence, tag by tag."""
    out, start, kind = set(), None, None
    for i, tag in enumerate([*tags, "O"]):
        bio, _, name = tag.partition("-")
        if start is not None and (bio in ("B", "O") or name != kind):
            out.add((kind, start, i - 1))
            start = None
        if bio == "B" or (bio == "I" and start is None):
            start, kind = i, name
    return out


def _one_hot(k):
    return [1.0 if i == k else 0.0 for i in range(5)]


def test_entities_against_reading(spark):
    rng = random.Random(11)
    rows, true_all, pred_all, right, total = [], [], [], 0, 0
    for s in range(60):
        n = rng.choice([0, 1, 2, 7, 30])
        gold = [rng.choice([-100, 0, 1, 2, 3, 4]) for _ in range(n)]
        guess = [g if g >= 0 and rng.random() < 0.7 else rng.randrange(5) for g in gold]
        rows.append((gold, [_one_hot(k) for k in guess]))
        kept = [(NAMES[g], NAMES[p]) for g, p in zip(gold, guess) if g != -100]
        right, total = right + sum(g == p for g, p in kept), total + len(kept)
        true_all += [(s, *x) for x in _spans([g for g, _ in kept])]
        pred_all += [(s, *x) for x in _spans([p for _, p in kept])]
    df = spark.createDataFrame(rows, "labels array<int>, logits array<array<double>>")
    got = {r["entity"]: r for r in scores.entity_scores(df, NAMES).collect()}
    assert got["overall"]["accuracy"] == pytest.approx(right / total)
    for name in ("PER", "LOC", "overall"):
        t = {x for x in true_all if name in ("overall", x[1])}
        p = {x for x in pred_all if name in ("overall", x[1])}
        assert got[name]["support"] == len(t)
        assert got[name]["precision"] == pytest.approx(len(t & p) / len(p))
        assert got[name]["recall"] == pytest.approx(len(t & p) / len(t))
        assert got[name]["f1"] == pytest.approx(2 * len(t & p) / (len(t) + len(p)))


def test_entities_of_nothing(spark):
    df = spark.createDataFrame([([-100, -100], [_one_hot(1)] * 2)], "labels array<int>, logits array<array<double>>")
    for frame in (df, df.where("false")):
        rows = scores.entity_scores(frame, NAMES).collect()
        assert {r["entity"] for r in rows} == {"PER", "LOC", "overall"}
        assert all(r["f1"] == 0 and r["support"] == 0 for r in rows)


def test_classes_seen_only_on_one_side(spark):
    df = spark.createDataFrame([([9.0, 0.0, 0.0], 0), ([9.0, 0.0, 0.0], 1), ([0.0, 0.0, 9.0], 1)], "logits array<double>, label int")
    r = scores.classification_scores(df).first()
    assert r["accuracy"] == pytest.approx(1 / 3)
    assert r["macro_f1"] == pytest.approx((2 / 3 + 0 + 0) / 3)


def test_regression_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "g string, prediction double, label double")
    got = {r["g"]: r for r in scores.regression_scores(df, by=["g"]).collect()}
    assert got["a"]["pearson"] is None and got["a"]["mse"] == 2.5
    assert got["b"]["pearson"] == pytest.approx(1) and got["b"]["mse"] == 2.5
    empty = scores.regression_scores(df.where("false")).first()
    assert empty["mse"] is None and empty["pearson"] is None


def test_perplexity(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "loss double")
    assert scores.perplexity(df).first()[0] == pytest.approx(math.exp(2))


@pytest.mark.parametrize("chunk", [1, 7, 50, 10**6])
def test_smoothing_like_pandas(spark, chunk):
    rng = random.Random(2)
    rows = [(run, "loss", step, rng.uniform(-5, 5)) for run in ("r1", "r2") for step in sorted(rng.sample(range(2000), 400))]
    df = spark.createDataFrame(rows, "run_id string, tag string, step long, value double").repartition(5)
    got = series.smooth(df, smoothing=0.6, chunk=chunk).toPandas()
    for run, part in got.sort_values("step").groupby("run_id"):
        want = part["value"].ewm(alpha=0.4).mean()
        assert (part["smoothed"] - want).abs().max() < 1e-12
    assert len(got) == len(rows)


def test_missing_tag_and_latest(spark):
    log = spark.createDataFrame(
        [("p", "a", 1, "loss", 1, 0.5), ("p", "b", 3, "loss", 1, 0.4), ("p", "c", 3, "loss", 2, 0.3), ("q", "a", 9, "lr", 1, 0.1)],
        "parent string, run_id string, run_ts long, tag string, step long, value double",
    )
    assert metric_logs.metric_series(log, "none").count() == 0
    assert {(r["parent"], r["run_id"]) for r in metric_logs.latest_run(log).collect()} == {("p", "c"), ("q", "a")}
    best = scores.best_step(log, tag="loss", greater_is_better=False, by=("parent",)).first()
    assert (best["step"], best["value"]) == (2, 0.3)


def test_top_candidates_use_a_limit_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 0, p, 1.0) for p in "dcbaef"] + [(1, 0, "z", 2.0)], "sent_id long, mask_pos int, piece string, score double")
    top = scores.top_candidates(df.repartition(3), k=3)
    assert [r["piece"] for r in sorted(top.collect(), key=lambda r: r["rank"])] == ["z", "a", "b"]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], "input_ids array<int>")
    r = reports.sequence_length_report(empty).first()
    assert r["sequences"] == 0 and r["mean_length"] is None and r["good_share"] is None
    none = spark.createDataFrame([], "doc_id long, n_subwords long, n_words long, fertility double")
    assert reports.fertility_macro(none).first()["avg_fertility"] is None
    assert reports.fertility_micro(none).first()["fertility"] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(20, 1, 5.0), (60, 1, 5.0), (5, 0, 5.0)], "num_words long, stopwords long, average double")
    got = {(r["series"], r["bin"]): r["documents"] for r in reports.word_count_histogram(df).collect()}
    assert len(got) == 80
    assert {k: v for k, v in got.items() if v} == {("before", 0): 1, ("before", 10): 1, ("before", 39): 1, ("after", 0): 1, ("after", 39): 1}
    one = {(r["series"], r["bin"]): r["documents"] for r in reports.word_count_histogram(df.limit(1)).collect()}
    assert {k: v for k, v in one.items() if v} == {("before", 0): 1, ("after", 0): 1}


def test_length_report_like_numpy(spark):
    lengths = [3, 19, 20, 21, 1024, 1025, 8192, 9000, 40, 41]
    df = spark.createDataFrame([([1] * n,) for n in lengths], "input_ids array<int>")
    r, s = reports.sequence_length_report(df).first(), pd.Series(lengths)
    assert (r["sequences"], r["tokens"], r["min_length"], r["max_length"]) == (10, sum(lengths), 3, 9000)
    assert [r["p25"], r["p75"], r["p90"], r["p99"]] == [int(s.quantile(q)) for q in (0.25, 0.75, 0.9, 0.99)]
    assert r["median_length"] == s.median()
    assert (r["at_limit"], r["over_limit"], r["too_short"], r["good"]) == (1, 1, 2, 3)


def test_label_names(spark):
    rows = spark.createDataFrame([(1,), (0,), (7,)], "label int")
    named = scores.with_label_names(rows, scores.label_table(spark, NAMES))
    assert {(r["label"], r["label_name"]) for r in named.collect()} == {(1, "B-PER"), (0, "O"), (7, None)}


def test_wide_and_overlay(spark):
    log = spark.createDataFrame([("r", 1, "a", 1.0), ("r", 2, "b", 2.0), ("r", 1, "b", 3.0)], "run_id string, step long, tag string, value double")
    wide = {r["step"]: (r["a"], r["b"]) for r in series.wide_series(log, ["a", "b"]).collect()}
    assert wide == {1: (1.0, 3.0), 2: (None, 2.0)}
    assert {r["step"]: (r["a"], r["b"]) for r in series.overlay(log, "a", "b").collect()} == wide
    assert log.where(F.col("step") > 5).count() == 0


def test_smooth_with_nulls_and_long_memory(spark):
    import numpy as np
    import pandas as pd

    from lavra.operators import series

    rng = np.random.default_rng(1)
    for smoothing in (0.6, 0.99, 0.999):
        values = rng.normal(size=3000)
        values[rng.random(3000) < 0.3] = np.nan
        rows = [("r", "t", i * 3, None if np.isnan(v) else float(v)) for i, v in enumerate(values)] + [(None, "t", 5, 1.0)]
        log = spark.createDataFrame(rows, "run_id string, tag string, step long, value double")
        got = series.smooth(log, smoothing=smoothing, chunk=500).where("run_id = 'r'").toPandas().sort_values("step")["smoothed"]
        want = pd.Series(values).ewm(alpha=1 - smoothing).mean()
        assert np.allclose(got.to_numpy(float), want.to_numpy(), atol=1e-9, equal_nan=True)
    one = spark.createDataFrame([("r", "t", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0])], "run_id string, tag string, step long, value double")
    got = [r.smoothed for r in series.smooth(one).orderBy("step").collect()]
    assert np.allclose(got, [1, 1, 3.36 / 1.36, (3.36 * 0.6 + 4) / (1.36 * 0.6 + 1)])


def test_entity_scores_without_types_and_with_many(spark):
    from lavra.operators import scores

    rows = spark.createDataFrame([([0, 0], [[0.9, 0.1], [0.2, 0.8]])], "labels array<int>, logits array<array<double>>")
    only = scores.entity_scores(rows, ["O", "X"]).collect()
    assert [(r.entity, r.support, r.accuracy) for r in only] == [("overall", 0, 0.5)]
    names = ["O"] + [f"{p}-T{i}" for i in range(700) for p in "BI"]
    logits = [[float(j == k) for j in range(len(names))] for k in (1, 2, 0, 5)]
    many = {r.entity: r for r in scores.entity_scores(spark.createDataFrame([([1, 2, 0, 5], logits)], rows.schema), names).collect()}
    assert len(many) == 701 and many["overall"].support == 2 and many["T0"].f1 == 1 and many["T2"].f1 == 1 and many["T5"].support == 0
    assert scores.entity_scores(rows.limit(0), ["O", "B-X"]).where("entity = 'overall'").first().accuracy is None


def test_missing_tags_warn(spark):
    import pytest

    from lavra.sources import metric_logs

    log = spark.createDataFrame([("r", "loss", 1, 1.0)], "run_id string, tag string, step long, value double")
    with pytest.warns(UserWarning, match="'lr'"):
        assert metric_logs.warn_missing(log, ["loss", "lr"]) == ["lr"]


def test_training_on_an_empty_corpus(spark):
    from lavra.operators.unigram import train_unigram

    vocab = train_unigram(spark.createDataFrame([], "doc_id long, text string"), size=30).collect()
    assert len(vocab) == 30 and sorted(r.id for r in vocab) == list(range(30))
