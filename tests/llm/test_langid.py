import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lavra.llm import langid, queries

TABLE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    found = queries.op9(spark, TABLE)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{TABLE}/documents.parquet").select("doc_id", "lang")
    row = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert row[0] > 0.99 and row[1] < 0.005
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_subwords_against_slices():
    words = ["abc", "de", "éx", "f"]
    bucket, owner = langid._subwords(pa.array(words))
    counts = np.bincount(owner, minlength=4)
    for i, w in enumerate(words):
        framed = b" " + w.encode() + b" "
        runs = [framed[a : a + n] for n in (2, 3, 4) for a in range(len(framed) - n + 1)]
        assert counts[i] == len(runs), w
    again, _ = langid._subwords(pa.array(["zz", "abc"]))
    assert set(bucket[owner == 0]) <= set(again)


def test_odd_texts_and_models(spark):
    rows = [(i, f"the house and the garden {i}" if i % 2 else f"das haus und der garten {i}", "en" if i % 2 else "de") for i in range(400)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, "日本語の文章", None), (904, "x" * 1_000_000, None), (1, rows[1][1], "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("s"), "lang_pred": F.lit(1), "_found": F.lit(2)})
    model = langid.fit(frame)
    assert model.languages == ["de", "en"]
    found = {r.doc_id: r for r in langid.identify(frame.drop("_found"), model).collect()}
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") and not found[i].rejected for i in range(400))
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (900, 901, 902))
    assert found[903].lang_pred in model.languages and found[903].rejected
    assert langid.fit(frame.where("lang IS NULL")) is None and langid.fit(frame.limit(0)) is None
    none = langid.identify(frame.drop("_found"), None).select("lang_pred", "rejected").distinct().collect()
    assert [tuple(r) for r in none] == [("und", True)]
    assert langid.identify(frame.drop("_found").limit(0), model).count() == 0
    one = langid.fit(frame.where("lang = 'en'"))
    assert one.languages == ["en"]


def _random_words(n: int, seed: int) -> list[str]:
    letters = np.random.default_rng(seed).integers(97, 123, (n, 7)).astype(np.uint8)
    return [bytes(row).decode() for row in letters]


def _model(k: int) -> langid.Model:
    logits = np.random.default_rng(k).normal(0, 1, (langid.BUCKETS, k)).astype(np.float32)
    return langid.Model([f"l{j}" for j in range(k)], logits, 1.0, 0.0)


def test_memory_does_not_follow_the_distinct_words(spark):
    words = _random_words(500_000, 1)
    texts = pa.array([" ".join(words[a : a + 500]) for a in range(0, len(words), 500)])
    langs = pa.array(["en"] * len(texts))
    batch = pa.RecordBatch.from_arrays([langs, texts], ["lang", "text"])
    few, many = (langid._apply(SimpleNamespace(value=_model(k))).func for k in (4, 64))
    for work in (lambda: few(texts), lambda: many(texts), lambda: [b.num_rows for b in langid._bags()([batch])]):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert most < 120


def test_words_of_many_parts_give_the_sums_of_their_subwords(monkeypatch):
    words = [*_random_words(300, 2), "é", "日本語", "a", "x" * 700]
    model = _model(3)
    monkeypatch.setattr(langid, "_WORD_BYTES", 64)
    sums = langid._word_sums(pa.array(words), model.logits)
    for i, w in enumerate(words):
        bucket, _ = langid._subwords(pa.array([w]))
        assert sums[3, i] == len(bucket) and np.allclose(sums[:3, i], model.logits[bucket].sum(axis=0), rtol=1e-4, atol=1e-4)
    assert langid._word_sums(pa.array([], pa.string()), model.logits).shape == (4, 0)
