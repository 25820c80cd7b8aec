import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SMALL
from lavra.llm import queries, secrets

WITH_SECRETS = "/root/testdata/sf0.01"


def _checked(frame, texts):
    rows = {r.doc_id: r for r in secrets.secret_scan(frame).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        base = brute.secret_spans(t)
        assert [tuple(s) for s in rows[i].base] == base, (i, t)
        assert [tuple(s) for s in rows[i].more] == brute.entropy_spans(t, base), (i, t)


def test_whole_table_against_brute_force(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{WITH_SECRETS}/documents.parquet'").fetchall())
    frame = queries.op8(spark, WITH_SECRETS)
    assert frame.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = {r.doc_id: r for r in frame.collect()}
    for i, t in texts.items():
        base = brute.secret_spans(t)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 0


def test_made_texts(spark):
    rng = random.Random(4)
    parts = ["password", "Secret ", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "=", "abcdefgh1", "ab", "AKIA", "AKIAABCDEFGHIJKL", "é", "日本", "👍", "\n", "deadbeef" * 4, "0" * 31]
    strong = ["Zx9Qw3Lm7Tr5Vb1Nc8Kd2Jf", "example9Qw3Lm7Tr5Vb1Nc8Kd", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "3f2c9a1be07d4586fa12", "123e4567-e89b-12d3-a456-426614174000"]
    texts = {i: "".join(rng.choices(parts + [s + " " for s in strong], k=rng.randrange(12))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "token= token: abcdefghi", 1003: "x" * 2_000_000, 1004: "token=abcdefgh " * 300}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"base": F.lit(1), "more": F.lit(2), "_t": F.lit(3)})
    _checked(frame, texts)


def test_many_hits_take_linear_time(spark):
    sums = [hashlib.md5(str(i).encode()).hexdigest() for i in range(50_000)]
    keys = [f"Zx9Qw3Lm7Tr5Vb1Nc8Kd{i:05d}" for i in range(3_000)]
    texts = {1: "\n".join(f"{s}  file{i}" for i, s in enumerate(sums)), 2: " ".join(f"{k} token={s}" for k, s in zip(keys, sums))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    begun = time.perf_counter()
    rows = {r.doc_id: r for r in secrets.secret_scan(frame).collect()}
    assert time.perf_counter() - begun < 60
    for i, t in texts.items():
        base = brute.secret_spans(t)
        assert [tuple(s) for s in rows[i].base] == base
    assert len(rows[1].base) == 50_000 and rows[1].more == []
    at = [m.start() for m in re.finditer("Zx9", texts[2])]
    assert [s.start for s in rows[2].more] == at and len(at) == 3_000


def test_harmless_words_clear_only_what_is_near(spark):
    key, rng = "Zx9Qw3Lm7Tr5Vb1Nc8Kd2Jf", random.Random(5)
    long = "".join(rng.choices(secrets.ALPHABET[:64], k=300))
    texts = dict(
        enumerate(
            [key, f"/data/sample/{key}", f"example/a/sample/{key}", f"{key}/example", f"{long}000000{long}", f"example-{key}", f"{key}EXAMPLE",
             "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", f"dummy/{key}/example/" + "a1-" * 30 + key, "abcdefgh" * 9 + "1"]
        )
    )
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _checked(frame, texts)
    found = {r.doc_id for r in secrets.secret_scan(frame).collect() if r.more}
    assert {0, 1, 2, 4, 8} <= found and not {5, 6, 7, 9} & found


def test_window_entropy(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices(secrets.ALPHABET[:: rng.choice([1, 3, 20])], k=rng.randrange(20, 60))) for _ in range(60)]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.window_entropy(F.col("w")).alias("h"))
    for row in frame.collect():
        assert row.h == pytest.approx(brute.entropy_windows(row.w), abs=1e-9)


def test_empty_and_repeated_rows(spark):
    assert secrets.secret_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, None)], "doc_id long, text string")
    assert [len(r.base) for r in secrets.secret_scan(twice).collect()] == [1, 1, 0]


def test_main_path_is_native(spark):
    plan = queries.op8(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
