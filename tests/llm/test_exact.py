import hashlib
import random

from pyspark.sql import functions as F

from conftest import SMALL
from lavra.llm import exact, queries


def _plainly(rows):
    """rows: (key, text). Sorted (key, keep, size, kept, digest)."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for key, text in rows:
        same = groups[text or ""]
        keep = max((k for k in same if k is not None), default=None)
        out.append((key, keep, len(same), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(frame):
    return sorted(map(tuple, exact.exact_groups(frame).collect()), key=repr)


def _made(rng):
    texts = ["".join(rng.choices("ab", k=rng.randrange(9))) for _ in range(900)] + ["hot"] * 900
    rows = [(rng.randrange(10**6), t) for t in texts]
    rows += [(5, None), (6, ""), (None, "hot"), (None, "only here"), (None, "twice"), (None, "twice"), (7, "x" * 2_000_000), (8, "x" * 2_000_000), (9, "x" * 1_999_999)]
    rows += [(10, "same row"), (10, "same row"), (11, "a "), (12, "A "), (13, "é"), (14, "é")]
    rng.shuffle(rows)
    return rows


def test_groups_against_brute_force(spark):
    rows = _made(random.Random(3))
    assert _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == _plainly(rows)


def test_full_filter_gives_the_same_groups(spark, monkeypatch):
    rows = [(i, f"text {i % 6000}") for i in range(9000)]
    monkeypatch.setattr(exact, "LEAST_WORDS", 1)
    monkeypatch.setattr(exact, "MOST_WORDS", 16)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _plainly(rows)


def test_empty_table_and_clashing_names(spark):
    names = "doc_id long, text string, possible int, word int, sha int, h int, n int"
    assert _got(spark.createDataFrame([], names)) == []
    frame = spark.createDataFrame([(1, "a", 1, 2, 3, 4, 5), (2, "a", 9, 9, 9, 9, 9), (3, "b", 0, 0, 0, 0, 0)], names)
    assert _got(frame) == _plainly([(1, "a"), (2, "a"), (3, "b")])
    kept = exact.keep_largest(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "a", 9, 9, 9, 9, 9), (3, "b", 0, 0, 0, 0, 0)]


def test_whole_rows_kept(spark):
    rows = _made(random.Random(4))
    kept = exact.keep_largest(spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.create_map(F.lit("k"), F.col("doc_id"))))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = {}
    for key, text in rows:
        seen = want.get(text or "")
        want[text or ""] = max([(key, text)] + ([seen] if seen else []), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(k, t or "") for k, t in got] == sorted(((k, t or "") for k, t in want.values()), key=repr)


def test_few_rows_move_and_none_through_python(spark):
    rows = [(i, f"text {i if i > 100 else 1}") for i in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = exact._filter(frame, "text")
    tested = exact.tested(frame.withColumn("w", exact._word(F.col("text"))), "w", held, "possible")
    assert 101 <= tested.where("possible").count() < 400
    assert tested.where("possible and doc_id <= 100").count() == 101
    plan = tested._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    plan = queries.op11(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
