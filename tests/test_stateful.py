import pytest
from pyspark.sql import functions as F

from lavra.operators.cuts import shuffle_key
from lavra.streaming import ingest, stateful


def _run(spark, incoming, out):
    """Once-only rows and totals, one file a trigger; each call starts anew from the progress on disk."""
    schema = "doc_id long, lang string, n long"
    kept = stateful.each_once(ingest.read_arriving(spark, incoming, schema=schema, files_per_trigger=1))
    split = stateful.arrival_split("doc_id", share=0.3, seed=7).alias("split")
    query = ingest.write_new(kept.select("*", split), f"{out}/rows", f"{out}/rows-progress")
    query.awaitTermination()
    once = ingest.read_arriving(spark, f"{out}/rows", schema=f"{schema}, split string", files_per_trigger=3)
    totals = stateful.running_totals(once, by="lang", sums=["n"], spread_by="doc_id")
    ingest.write_new(totals, f"{out}/totals", f"{out}/totals-progress").awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


def test_five_triggers_a_restart_and_a_repeated_file(spark, tmp_path):
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    lang = F.when(F.col("id") % 10 < 7, "en").when(F.col("id") % 10 < 9, "pt")
    rows = spark.range(500).select(F.col("id").alias("doc_id"), lang.alias("lang"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    rows = rows.union(spark.sql("SELECT CAST(NULL AS long), 'xx', 5L")).cache()

    def arrive(part):
        rows.where(part).coalesce(1).write.mode("append").parquet(incoming)

    for part in ("doc_id < 100", "doc_id between 100 and 199", "doc_id between 150 and 299"):
        arrive(part)
    assert sum(n > 0 for n in _run(spark, incoming, out)) == 3
    first = {r.doc_id: r.split for r in spark.read.parquet(f"{out}/rows").collect()}
    assert len(first) == 300
    # A restart: a file that came before, a new one, and one with a null key.
    for part in ("doc_id < 100", "doc_id >= 250", "doc_id is null", "doc_id is null"):
        arrive(part)
    _run(spark, incoming, out)
    got = spark.read.parquet(f"{out}/rows")
    assert sorted(map(str, got.drop("split").collect())) == sorted(map(str, stateful.each_once(rows).collect()))
    splits = {r.doc_id: r.split for r in got.collect()}
    assert {k: splits[k] for k in first} == first
    assert 0.2 < sum(s == "test" for s in splits.values()) / 501 < 0.4
    totals = stateful.latest_totals(spark.read.parquet(f"{out}/totals"), by="lang", sums=["n"])
    want = rows.groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"))
    assert sorted(map(str, totals.collect())) == sorted(map(str, want.collect()))


def test_keys_leave_the_state_behind_the_watermark(spark, tmp_path):
    incoming = str(tmp_path / "in")
    hours = spark.range(100).select("id", (F.col("id") % 20).alias("doc_id"), F.timestamp_seconds((F.col("id") + 480_000) * 3600).alias("at"))
    schema = "doc_id long, at timestamp"
    for low in range(0, 100, 20):
        hours.where(F.col("id").between(low, low + 19)).drop("id").coalesce(1).write.mode("append").parquet(incoming)
        stream = ingest.read_arriving(spark, incoming, schema=schema, files_per_trigger=1)
        kept = stateful.each_once(stream, time="at", within="30 hours")
        query = ingest.write_new(kept, str(tmp_path / "out"), str(tmp_path / "progress"))
        query.awaitTermination()
        assert all(s["numRowsTotal"] <= 20 for p in query.recentProgress for s in p["stateOperators"])
    # Hours 0 to 19 bring all keys, known until the watermark, 30 hours behind, passes hours 30 to 49: so the
    # rows of hours 20 to 79 are repetitions, and those from hour 80 on are new again.
    got = spark.read.parquet(str(tmp_path / "out")).select((F.unix_timestamp("at") / 3600 - 480_000).cast("int").alias("hour"))
    assert sorted(r.hour for r in got.collect()) == [*range(20), *range(80, 100)]


def test_empty_input_and_wrong_parameters(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, lang string")
    assert stateful.each_once(empty).count() == 0
    with pytest.raises(ValueError):
        stateful.each_once(empty, time="at")
    for share in (0, 1, 1.5):
        with pytest.raises(ValueError):
            stateful.arrival_split("doc_id", share=share, seed=1)
    ids = spark.range(1000).select("id", stateful.arrival_split("id", share=0.5, seed=3).alias("s"), shuffle_key("id", 3).alias("h"))
    assert ids.where("(s = 'test') <> (substring(h, 1, 1) < '8')").count() == 0
