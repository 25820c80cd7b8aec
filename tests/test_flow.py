import gzip
import json

import pytest
import zstandard
from conftest import SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lavra import session
from lavra.plans import curation
from lavra.sources import corpora, storage
from lavra.streaming import ingest


def test_raw_to_rows_builds_once(spark, tmp_path):
    sources = [corpora.table(spark, SMALL, "documents")]
    first = curation.raw_to_rows(spark, sources, str(tmp_path), size=1000, model="word")
    rows = first.count()
    assert rows > 0 and {r[0] for r in first.select("split").distinct().collect()} == {"train", "test"}
    again = curation.raw_to_rows(spark, [], str(tmp_path), size=1000, model="word")
    assert again.count() == rows
    corpus = spark.read.parquet(str(tmp_path / "corpus"))
    assert corpus.count() == rows and corpora.reload(spark, str(tmp_path / "corpus")).where("split <> 'train'").count() == 0


def _pile(spark, word, n=30):
    text = " ".join([word, "the", "of"] * 40)
    return spark.createDataFrame([(i, f"{text} {i}", "en") for i in range(n)], "doc_id long, text string, lang string")


def test_other_sources_are_not_taken_for_the_stored_ones(spark, tmp_path):
    apples, pears = _pile(spark, "apple"), _pile(spark, "pear")
    path = str(tmp_path / "corpus")
    assert curation.curate(spark, [apples], path).count() == 30
    assert curation.curate(spark, [_pile(spark, "apple")], path).count() == 30
    for other in ([pears], [apples, pears], [apples.where("doc_id < 99")]):
        with pytest.raises(ValueError, match="other parameters or sources"):
            curation.curate(spark, other, path)
    with pytest.raises(ValueError, match="other parameters or sources"):
        curation.curate(spark, [apples], path, seed=7)
    assert "pear" in curation.curate(spark, [pears], path, rebuild=True).first()["text"]


def test_changed_files_and_stages_are_noticed_along_the_chain(spark, tmp_path):
    source, folder = str(tmp_path / "raw"), tmp_path / "flow"
    _pile(spark, "apple").write.parquet(source)

    def read():
        return spark.read.parquet(source)

    first = storage.identity(read())
    assert storage.identity(read()) == first and storage.identity(read().where("doc_id < 5")) != first
    rows = curation.raw_to_rows(spark, [read()], str(folder), size=50, model="word")
    assert curation.raw_to_rows(spark, [read()], str(folder), size=50, model="word").count() == rows.count()
    corpus, vocab = (spark.read.parquet(str(folder / n)) for n in ("corpus", "vocabulary"))
    with pytest.raises(ValueError):
        curation.raw_to_rows(spark, [read()], str(folder), size=40, model="word")
    with pytest.raises(ValueError):  # the rows were made with another vocabulary
        curation.tokenize(corpus, vocab.where("id < 20"), str(folder / "tokenized"), model="word", made_from={"size": 50, "key": "doc_id"})
    with pytest.raises(ValueError):
        curation.vocabulary(corpus.where("doc_id < 9"), str(folder / "vocabulary"), size=50, model="word")
    _pile(spark, "pear").selectExpr("doc_id + 100 AS doc_id", "text", "lang").write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="corpus"):
        curation.raw_to_rows(spark, [read()], str(folder), size=50, model="word")
    # A stage that is built anew is another one for those made from it.
    curation.curate(spark, [read()], str(folder / "corpus"), seed=7, rebuild=True)
    with pytest.raises(ValueError, match="vocabulary"):
        curation.vocabulary(spark.read.parquet(str(folder / "corpus")), str(folder / "vocabulary"), size=50, model="word")


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        corpora.reload(spark, str(tmp_path / "none"))


def test_reload_without_splits(spark, tmp_path):
    storage.save(spark.range(5), str(tmp_path / "t"))
    assert corpora.reload(spark, str(tmp_path / "t")).count() == 5


def test_materialize(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    for rebuild in (False, False, True):
        assert storage.materialize(spark, build, path, rebuild=rebuild).count() == 3
    assert len(built) == 2


@pytest.mark.parametrize("suffix", ["", ".gz", ".zst"])
def test_json_lines(spark, tmp_path, suffix):
    lines = "".join(json.dumps({"doc_id": i, "text": f"t\n{i}"}) + "\n" for i in range(9)).encode()
    packed = {"": bytes, ".gz": gzip.compress, ".zst": zstandard.ZstdCompressor().compress}[suffix](lines)
    (tmp_path / f"part.jsonl{suffix}").write_bytes(packed)
    got = corpora.scan_json_lines(spark, f"{tmp_path}/*.jsonl*").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["lang"]) for r in got] == [(i, f"t\n{i}", None) for i in range(9)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("três")
    (tmp_path / "c.md").write_text("no")
    got = corpora.scan_text_files(spark, str(tmp_path)).collect()
    assert sorted((r["file_path"].rsplit("/", 1)[1], r["text"]) for r in got) == [("a.txt", "one\ntwo\n"), ("b.txt", "três")]


def test_language_reaches_the_scan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("lang") == "en").select("doc_id")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_words_are_split_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    plan = ingest.curate(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Join" not in plan and "Exchange" not in plan


def test_stream_takes_only_new_files(spark, tmp_path):
    incoming, out = tmp_path / "in", tmp_path / "out"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = {r["doc_id"] for r in ingest.curate(docs).select("doc_id").collect()}
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        docs.where(part).write.mode("append").parquet(str(incoming))
        stream = ingest.curate(ingest.read_arriving(spark, str(incoming), files_per_trigger=1)).select("doc_id")
        ingest.write_new(stream, str(out), str(tmp_path / "progress")).awaitTermination()
    got = [r["doc_id"] for r in spark.read.parquet(str(out)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_scratch_follows_the_session(spark):
    assert session.new_scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_spread_leaves_large_inputs_alone(spark):
    many = spark.range(100, numPartitions=64)
    assert session.spread(many) is many
    assert session.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_stored_stages_know_their_parameters(spark, tmp_path):
    import pytest

    from lavra.plans import curation

    docs = spark.createDataFrame([(i, f"w{i % 50} w{i % 7} the cat") for i in range(400)], "doc_id long, text string")
    path = str(tmp_path / "vocabulary")
    assert curation.vocabulary(docs, path, size=30, model="word").count() == 30
    assert curation.vocabulary(docs, path, size=30, model="word").count() == 30
    with pytest.raises(ValueError, match="other parameters"):
        curation.vocabulary(docs, path, size=20, model="word")
    assert curation.vocabulary(docs, path, size=20, model="word", rebuild=True).count() == 20


def _named(spark, path, **options):
    rows = corpora.scan_text_files(spark, str(path), **options)
    return rows, sorted((r.file_path, r.text) for r in rows.collect())


def test_text_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    from lavra.sources import text_files

    root = tmp_path / "in dir%20é"
    names = ["a.txt", "_x=1.txt", "sub/b c%41+é.txt", "_k=1/c.txt", "sub/deep/d.txt", "dir.txt/inner.txt", "bom.txt", "sub/x#?;[1].txt", "n ~^.txt"]
    passed = ["_hidden.txt", ".dot.txt", "_sub/c.txt", ".sub/c.txt", "sub/deep/d.TXT", "z.json", "dir.txt/inner.csv"]
    for i, name in enumerate([*names, *passed]):
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes("﻿é {}\r\n".format(i).encode())
    (root / "empty.txt").write_bytes(b"")
    (root / "link").symlink_to(root / "sub")
    (root / "gone.txt").symlink_to(root / "nothing")
    monkeypatch.setattr(text_files, "_NAMES", 2)
    monkeypatch.setattr(text_files, "_FILES", 3)
    for path in (root, f"{root}/", f"file://{root}/sub"):
        rows, got = _named(spark, path)
        assert "Relation [path" in rows._jdf.queryExecution().optimizedPlan().toString()  # a table of names, not the files
        with monkeypatch.context() as only_spark:
            only_spark.setattr(text_files, "reachable", lambda *_: None)
            assert _named(spark, path)[1] == got
    assert len(_named(spark, root)[1]) == len(names) + 3


def test_text_files_that_only_spark_reads_are_left_to_it(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"two"))
    assert [t for _, t in _named(spark, tmp_path, suffix=".gz")[1]] == ["two"]
    assert [t for _, t in _named(spark, tmp_path / "a*")[1]] == ["one"]
    assert [t for _, t in _named(spark, tmp_path / "a.txt")[1]] == ["one"]
    assert [t for _, t in _named(spark, tmp_path, suffix="{.txt,.csv}")[1]] == ["one"]
    with pytest.raises(AnalysisException):
        corpora.scan_text_files(spark, str(tmp_path / "none"))


def test_bytes_of_text_files_stay(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\x00\xe9 bad")
    text = corpora.scan_text_files(spark, str(tmp_path)).select(F.col("text").cast("binary")).first()[0]
    assert bytes(text) == b"\xff\x00\xe9 bad"
