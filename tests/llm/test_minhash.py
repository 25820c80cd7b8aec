import math
import random

import duckdb
import pytest

import brute
from conftest import SMALL
from lavra.llm import minhash, queries
from lavra.llm.components import components


def _sorted(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_whole_table_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    assert _sorted(queries.op7(spark, SMALL)) == brute.components(rows)


def test_near_copies_chains_and_ties(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([6, 20, 60, 300]))
        for _ in range(rng.choice([1, 4, 14])):
            edited = list(base)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((n, " ".join(edited)))
            n += 1
            base = edited if rng.random() < 0.3 else base
    passage = " ".join(rng.choices(words, k=60))
    rows += [(n + i, passage + " " + " ".join(rng.choices(words, k=90))) for i in range(40)]
    rows += [(0, rows[0][1]), (2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE two"), (2005, "two one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS cid", "2 AS value")
    assert _sorted(minhash.near_duplicates(frame)) == brute.components(rows)


@pytest.mark.parametrize("threshold", [85, 80])
def test_texts_inside_longer_texts(spark, threshold):
    # Words of one pair only, so that a pair that is missed joins through no other text.
    rows, n = [], 0
    for words in range(30, 71):
        for more in range(1, 17):
            text = [f"p{n}w{i}" for i in range(words + more)]
            if (words - 4) * 100 >= threshold * (words + more - 4):
                rows += [(n, " ".join(text[:words])), (n + 1, " ".join(text))]
                n += 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, threshold=threshold).collect()}
    want = {i: c for a in range(0, n, 2) for i, _, c, _ in brute.components(rows[a : a + 2], threshold)}
    assert got == want and all(c == i - i % 2 for i, c in want.items())


@pytest.mark.parametrize("threshold", [50, 80, 85, 90, 99])
def test_shared_sketch_values_by_the_binomial_tail(threshold):
    t = threshold / 100
    tail = [sum(math.comb(32, i) * t**i * (1 - t) ** (32 - i) for i in range(s)) for s in range(33)]
    assert minhash.least_shared(threshold) == max(s for s in range(33) if tail[s] < 1e-8)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        edited = list(base)
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(edited)))
    assert _sorted(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.components(rows)


def test_empty_table_null_keys_and_long_word(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    text = "a b c d e f"
    rows = [(None, text), (7, text), (None, "q r s t u v"), (8, "x" * 3_000_000 + " y")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=repr)
    assert got == sorted([(None, 7, False), (7, 7, True), (None, None, True), (8, 8, True)], key=repr)


@pytest.mark.parametrize("n", [2, 3, 17])
def test_chain_of_links(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(n + 1)}
