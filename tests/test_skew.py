"""A third or more of all rows on one word, document, series or mask: results stay whole, plans stay split."""

import random

import pytest
from pyspark.sql import functions as F

from lavra.operators import cuts, encoding, measures, scores, series, skew, tasks, vocabulary
from lavra.sources import metric_logs


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(9)
    hot = "the same words again and again , " * 40
    texts = [hot if i % 3 == 0 else " ".join(rng.choices(["the", "cat", "zzz", ","], k=60)) for i in range(300)]
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_words_stay_where_they_are_and_whole(copies):
    texts = copies.select("doc_id", "text")
    vocab = vocabulary.word_vocabulary(texts)
    tokens = vocabulary.with_tokens(texts)
    joined = encoding.encode_tokens(tokens, vocab, limit=0)
    same = encoding.encode_tokens(tokens, vocab)
    assert sorted(joined.collect()) == sorted(same.collect())


def test_heavy_keys_are_not_shuffled(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("w"), F.col("id"))).alias("word"), "id")
    table = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.col("id").alias("n")).unionByName(spark.sql("SELECT 'hot' AS word, -1L AS n"))
    assert skew.heavy_keys(rows, "word") == ["hot"]
    for how in ("left", "inner"):
        want = sorted(map(tuple, rows.join(table, "word", how).collect()), key=repr)
        for heavy in (skew.HEAVY_KEYS, 1):  # at 1 no key is heavy
            skew.HEAVY_KEYS, kept = heavy, skew.HEAVY_KEYS
            try:
                out = skew.heavy_join(rows, table, "word", how)
                assert sorted(map(tuple, out.collect()), key=repr) == want
            finally:
                skew.HEAVY_KEYS = kept
    # What is dealt by word holds no hot row: no task has more than its share.
    light = rows.where(~F.col("word").isin("hot")).repartition(8, "word")
    sizes = [r["count"] for r in light.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.3 * sum(sizes) / len(sizes)


def test_bloom_filter_before_a_semi_join(spark, monkeypatch):
    rows = spark.range(200_000).select((F.col("id") * 7 - 5).alias("doc_id"), F.lit(1).alias("_filter_words"))
    monkeypatch.setattr(cuts, "BROADCAST_KEYS", 0)
    got = cuts.every_kth(rows, ratio=0.01)
    assert [r["doc_id"] for r in got.orderBy("doc_id").collect()] == list(range(-5, 7 * 200_000 - 5, 700))
    chosen = rows.where(F.col("doc_id") % 700 == 695).select("doc_id")
    passed = skew.may_hold(rows, chosen, "doc_id", 2000)
    assert passed.columns == rows.columns and 2000 <= passed.count() < 2000 + 0.03 * 200_000
    assert "SortMergeJoin" not in _plan(passed) and "hashpartitioning" not in _plan(passed)


def test_word_counts_combine_before_the_shuffle(copies):
    plan = _plan(vocabulary.word_counts(copies))
    assert plan.index("partial_count") > plan.index("hashpartitioning(word")
    total = vocabulary.word_counts(copies).agg(F.sum("count")).first()[0]
    assert total == vocabulary.with_tokens(copies).agg(F.sum(F.size("tokens"))).first()[0]


def test_copies_split_exactly(copies):
    out = cuts.train_test_split(copies.drop("lang"))
    assert out.where("split = 'test'").count() == 30 and out.count() == 300
    assert measures.measure_documents(copies).count() == 100


def test_hot_series_is_chunked(spark):
    log = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("run_id"),
        F.lit("loss").alias("tag"), F.col("id").alias("step"), F.sin("id").alias("value"),
    )
    out = series.smooth(log, chunk=256)
    assert "hashpartitioning(run_id" in _plan(out) and "_chunk" in _plan(out)
    got = out.where("run_id = 'hot'").toPandas().sort_values("step")
    assert (got["smoothed"] - got["value"].ewm(alpha=0.4).mean()).abs().max() < 1e-12


def test_hot_mask_and_run(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("sent_id"), F.lit(0).alias("mask_pos"),
        F.concat(F.lit("p"), "id").alias("piece"), (F.col("id") % 7).cast("double").alias("score"),
    )
    top = scores.top_candidates(rows, k=5)
    assert top.where("sent_id = 0").count() == 5 and top.count() == 5 + 6000
    log = rows.select(F.lit("p").alias("parent"), F.col("sent_id").cast("string").alias("run_id"), F.col("score").alias("run_ts"), "piece")
    newest = log.agg(F.max(F.struct("run_ts", "run_id"))).first()[0]["run_id"]
    assert metric_logs.latest_run(log).count() == log.where(F.col("run_id") == newest).count()


def test_batches_of_copies(spark):
    rows = spark.range(999).select(F.col("id").alias("doc_id"), F.array_repeat(F.lit(1), F.when(F.col("id") % 3 == 0, 9).otherwise(2)).alias("input_ids"))
    out = tasks.batch_pad(rows, batch_size=10)
    assert out.count() == 999 and out.select(F.size("input_ids")).distinct().count() == 1


def test_large_vocabulary_is_numbered_on_the_executors(copies, monkeypatch):
    texts = copies.select("doc_id", "text")
    want = vocabulary.word_vocabulary(texts, size=9).collect()
    monkeypatch.setattr(vocabulary, "BROADCAST_PIECES", 0)
    monkeypatch.setattr(cuts, "ONE_TASK_ROWS", 0)
    got = vocabulary.word_vocabulary(texts, size=9)
    assert sorted(got.collect()) == sorted(want) and len(want) == 9
