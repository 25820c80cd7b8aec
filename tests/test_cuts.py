import datetime
import hashlib
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lavra.operators import cuts


def _table(spark, keys, parts=7):
    return spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 1003])
def test_split_is_exact_and_whole(spark, n):
    keys = random.Random(n).sample(range(10**12), n)
    out = cuts.train_test_split(_table(spark, keys)).collect()
    test = {r["doc_id"] for r in out if r["split"] == "test"}
    assert sorted(r["doc_id"] for r in out) == sorted(keys)
    assert len(test) == math.ceil(0.1 * n)
    ranked = sorted(keys, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert test == set(ranked[: len(test)])


def test_split_goes_on_when_a_bucket_is_large(spark, monkeypatch):
    monkeypatch.setattr(cuts, "_SMALL", 1)
    keys = list(range(3000))
    out = cuts.train_test_split(_table(spark, keys), test_size=0.37)
    assert out.where("split = 'test'").count() == math.ceil(0.37 * 3000)


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_partitioning_does_not_matter(spark, parts):
    df = _table(spark, range(500), parts)
    test = cuts.train_test_split(df).where("split = 'test'")
    sample = cuts.every_kth(df, ratio=0.01)
    head = cuts.head_percent(df, percent=3)
    digest = [sorted(r[0] for r in d.select("doc_id").collect()) for d in (test, sample, head)]
    base = _table(spark, range(500), 3)
    again = [cuts.train_test_split(base).where("split = 'test'"), cuts.every_kth(base, ratio=0.01),
             cuts.head_percent(base, percent=3)]
    assert digest == [sorted(r[0] for r in d.select("doc_id").collect()) for d in again]
    assert digest[1] == [0, 100, 200, 300, 400]
    assert digest[2] == list(range(15))


@pytest.mark.parametrize("descending", [False, True])
def test_ordered_cutoff_on_clustered_keys(spark, descending):
    rng = random.Random(3)
    keys = [rng.randrange(10) for _ in range(900)] + [rng.randrange(-10**15, 10**15) for _ in range(100)]
    df = _table(spark, keys)
    ranked = sorted(keys, reverse=descending)
    for n in (1, 57, 500, 999):
        cutoff, before, wanted = cuts.ordered_cutoff(df, "doc_id", lambda _: n, descending=descending)
        assert (cutoff, before, wanted) == (ranked[n - 1], ranked.index(ranked[n - 1]), n)


@pytest.mark.parametrize("one_task_rows", [cuts.ONE_TASK_ROWS, 0])
@pytest.mark.parametrize("n", [0, 1, 5, 20, 200, 999])
def test_top_rows_cuts_ties_in_order(spark, monkeypatch, n, one_task_rows):
    monkeypatch.setattr(cuts, "ONE_TASK_ROWS", one_task_rows - (n == 0))
    rng = random.Random(5)
    rows = [(f"w{i}", rng.choice([1, 1, 1, 2, 3, 500])) for i in range(200)]
    df = spark.createDataFrame(rows, "word string, count long")
    got = cuts.top_rows(df, by="count", then="word", n=n).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
    assert sorted(map(tuple, got)) == sorted(want)


def test_numbers_follow_the_key(spark):
    keys = random.Random(1).sample(range(10**9), 777)
    got = cuts.number_rows(_table(spark, keys), key="doc_id").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["row_no"]) for r in got] == [(k, i) for i, k in enumerate(sorted(keys))]


def test_ratio_outside_takes_all(spark):
    df = _table(spark, range(20))
    assert cuts.every_kth(df, ratio=1.0).count() == cuts.every_kth(df, ratio=0).count() == 20


def test_fraction_and_head_roundings(spark):
    df = _table(spark, range(30))
    assert cuts.shuffled_fraction(df, fraction=0.05).count() == 1
    assert cuts.head_percent(df, percent=5).count() == 2
    assert cuts.head_percent(df, percent=5, rounding="down").count() == 1
    assert cuts.head_percent(df, percent=0).count() == 0


def test_head_reaches_the_scan(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "t"))
    head = cuts.head_percent(spark.read.parquet(str(tmp_path / "t")), percent=5)
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(doc_id,49)" in plan and head.count() == 50


def test_split_has_no_exchange(spark):
    out = cuts.train_test_split(spark.range(100).withColumnRenamed("id", "doc_id"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where(F.col("split") == "test").count() == 10


def test_repeated_keys_are_refused_and_pairs_of_columns_are_keys(spark):
    import pytest

    from lavra.operators import cuts

    rows = spark.range(200).selectExpr("id % 100 AS doc_id", "if(id < 100, 'a', 'b') AS source")
    with pytest.raises(ValueError, match="not unique"):
        cuts.train_test_split(rows)
    split = cuts.train_test_split(rows, key=("source", "doc_id"))
    assert split.where("split = 'test'").count() == 20 and split.count() == 200


def test_cut_over_the_whole_range_of_a_long(spark):
    from lavra.operators import cuts

    keys = [-(2**63), -(2**62), -5, 0, 7, 2**62, 2**63 - 2, 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for n in range(1, 9):
        assert cuts.ordered_cutoff(rows, "doc_id", lambda _, n=n: n)[0] == keys[n - 1]
        assert cuts.ordered_cutoff(rows, "doc_id", lambda _, n=n: n, descending=True)[0] == keys[-n]


def _ordered(values, descending=False):
    return sorted(values, key=lambda v: (v != v, v), reverse=descending)


@pytest.mark.parametrize("kind", ["string", "binary", "double", "float", "date", "timestamp", "decimal(12,3)"])
@pytest.mark.parametrize("descending", [False, True])
def test_cutoff_on_any_ordered_key(spark, kind, descending):
    rng = random.Random(kind)
    if kind in ("string", "binary"):
        keys = ["https://www." + "".join(rng.choices("ab/é日", k=rng.randrange(6))) for _ in range(150)] + ["", "z", "https", "é", "\U0001f600"]
        keys = [k.encode() for k in keys] if kind == "binary" else sorted(keys, key=str.encode)
    elif kind in ("double", "float"):
        keys = [rng.choice([0.0, -0.0, 1.5, -2.25, rng.randrange(-4, 4) * 2.0 ** rng.randrange(-100, 100)]) for _ in range(150)]
        keys += [float("inf"), -float("inf"), float("nan"), float("nan"), 5e-324 if kind == "double" else 2.0**-149]
    elif kind == "date":
        keys = [datetime.date(1960, 1, 1) + datetime.timedelta(rng.randrange(40_000)) for _ in range(150)]
    elif kind == "timestamp":
        keys = [datetime.datetime(1969, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**16)) for _ in range(150)]
    else:
        keys = [Decimal(rng.randrange(-10**11, 10**11)).scaleb(-3) for _ in range(150)]
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, len(keys))] + [(None,)], f"doc_id {kind}")
    ranked = sorted(keys, key=str.encode, reverse=descending) if kind == "string" else _ordered(keys, descending)
    for n in (1, 60, len(keys) - 3, len(keys) - 1, len(keys)):
        cutoff, before, wanted = cuts.ordered_cutoff(df, "doc_id", lambda _, n=n: n, descending=descending)
        inside = F.col("doc_id") >= cutoff if descending else F.col("doc_id") <= cutoff
        got = [r["doc_id"] for r in df.where(inside).collect()]
        got = sorted(got, key=str.encode, reverse=descending) if kind == "string" else _ordered(got, descending)
        last = ranked[n - 1]
        upto = max(i for i, k in enumerate(ranked) if k == last or (k != k and last != last)) + 1
        assert repr([abs(x) if x == 0 else x for x in got] if kind in ("double", "float") else got) == repr(
            [abs(x) if x == 0 else x for x in ranked[:upto]] if kind in ("double", "float") else ranked[:upto]
        )
        assert wanted == n and before in (None, next(i for i, k in enumerate(ranked) if k == last or (k != k and last != last)))


def test_head_of_a_text_key_and_of_no_rows(spark):
    df = spark.range(1000).select(F.concat(F.lit("key/"), F.hex("id")).alias("doc_id"))
    want = sorted(f"key/{i:X}" for i in range(1000))[:50]
    assert sorted(r[0] for r in cuts.head_percent(df, percent=5).collect()) == want
    assert cuts.head_percent(df.limit(0), percent=5).count() == 0
    with pytest.raises(TypeError, match="array"):
        cuts.head_percent(spark.range(3).select(F.array("id").alias("doc_id")), percent=50)


def test_wide_ties_are_cut_without_ordering_them(spark):
    # Ten million rows tie; a third of a million of them are wanted.
    df = spark.range(10_000_000).select(F.col("id").cast("string").alias("word"), F.when(F.col("id") < 5, 2).otherwise(1).alias("count"))
    top = cuts.top_rows(df, by="count", then="word", n=600_000)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrdered" not in plan
    assert top.count() == 600_000 and top.where("count = 2").count() == 5
    assert top.where("count = 1").agg(F.max("word")).first()[0] == sorted(str(i) for i in range(5, 10_000_000))[599_994]


def test_ties_in_both_columns_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(cuts, "ONE_TASK_ROWS", 0)
    rows = [("a", 1)] * 5 + [(None, 1)] * 3 + [("b", 1)] + [("c", 2)]
    df = spark.createDataFrame(rows, "word string, count long")
    for n, want in ((1, [("c", 2)]), (3, [("c", 2)] + [(None, 1)] * 2), (6, [("c", 2)] + [(None, 1)] * 3 + [("a", 1)] * 2), (10, rows)):
        assert sorted(map(tuple, cuts.top_rows(df, by="count", then="word", n=n).collect()), key=repr) == sorted(want, key=repr)
