import gzip
import hashlib
import random

import pyarrow.fs as fs
from pyspark.sql import functions as F

from conftest import SMALL
from lavra.llm import queries, warc


def _want(rows):
    last = {}
    for i, h in rows:
        if len(h.encode()) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, h in rows:
        refers = last.get(h) if i is not None and last.get(h, i) != i else None
        data = h.encode()
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def _made(spark):
    rng = random.Random(1)
    big = ["<p>" + "é" * n + "</p>" for n in (600, 497, 496, 4000)]
    rows = [(i, rng.choice([f"http://h{i % 7}.example.org/p{i % 11}", f"HTTPS://u@H{i % 3}.Example.org:8080/a?b=1#c", None, "no url\twith\nbreaks"]), rng.choice(big + [None, "", "x", "y" * 3000 + str(i)])) for i in range(300)]
    rows += [(5, "http://h.example.org", big[0]), (None, "http://h.example.org", big[0]), (299, rows[299][1], rows[299][2])]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"size": F.lit(1), "digest": F.lit(2), "payload": F.lit(3)})


def test_whole_table_round_trip(spark):
    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    got = queries.op10(spark, SMALL)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == _want(pages)


def test_made_pages_index_and_lookup(spark, monkeypatch):
    rows, frame = _made(spark)
    directory, folder = warc.write_archives(warc.mark_revisits(frame))
    captures = warc.read_blocks(directory, folder)
    records = warc.read_records(captures, folder)
    got = sorted((tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == _want([(i, h or "") for i, _, h in rows])
    payloads = {r.page_id: r.payload for r in records.where("record_type = 'response'").collect()}
    assert all(bytes(payloads[i]).decode() == (h or "") for i, _, h in rows if i in payloads)
    keys = {r.url_key for r in captures.collect()}
    assert "org,example,h1:8080)/a?b=1" in keys and "org,example,h1)/p1" in keys and "" in keys

    # Small blocks and segments: keys that span blocks and segments are found whole.
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "SEGMENTS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        directory, folder = warc.write_archives(warc.mark_revisits(frame))
        assert directory.count() >= 70
        urls = [u for u in dict.fromkeys(u for _, u, _ in rows)][:40] + ["http://nowhere.example.org/"]
        found = warc.lookup(spark.createDataFrame([(u,) for u in urls], "url string"), directory, folder)
        by_key = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("k"))
        wanted = {r.k.replace("\t", "_").replace("\n", "_").replace(" ", "_") for r in by_key.collect()}
        everything = warc.read_blocks(directory, folder)
        want = sorted(tuple(r) for r in everything.where(F.col("url_key").isin(*wanted)).select("url_key", "file", "offset").collect())
        assert sorted(tuple(r) for r in found.select("url_key", "file", "offset").collect()) == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_looks_up_every_url(spark, monkeypatch, tmp_path):
    rows, frame = _made(spark)
    frame.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    asked, lookup = [], warc.lookup

    def spied(urls, *more):
        asked.extend(r.url for r in urls.collect())
        return lookup(urls, *more)

    monkeypatch.setattr(warc, "lookup", spied)
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    assert sorted(map(tuple, queries.op10(spark, str(tmp_path)).collect()), key=repr) == _want([(i, h or "") for i, _, h in rows])
    assert set(asked) == {u for _, u, _ in rows} and None in asked


def test_archives_are_plain_gzip_members(spark):
    _, frame = _made(spark)
    _, folder = warc.write_archives(warc.mark_revisits(frame))
    store, path = fs.FileSystem.from_uri(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == 303 and whole.endswith(b"\r\n\r\n")


def test_empty_table(spark):
    _, frame = _made(spark)
    directory, folder = warc.write_archives(warc.mark_revisits(frame.limit(0)))
    assert warc.read_records(warc.read_blocks(directory, folder), folder).count() == 0
    assert warc.lookup(spark.createDataFrame([("http://a.example",)], "url string"), directory, folder).count() == 0


def test_a_very_common_key_and_thousands_of_blocks(spark, monkeypatch):
    """A third of the captures have one key, and each block is sent to Python once for each segment it is in."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "SEGMENTS", 4)
    ids = spark.range(6000)
    url = F.when(F.col("id") % 3 == 0, "http://hot.example.org/").otherwise(F.concat(F.lit("http://h"), (F.col("id") % 97).cast("string"), F.lit(".org/"), F.col("id").cast("string")))
    pages = ids.select(F.col("id").alias("page_id"), url.alias("url"), F.lit("x").alias("html"))
    directory, folder = warc.write_archives(warc.mark_revisits(pages))
    blocks = directory.count()
    assert blocks >= 3000
    asked = pages.where("id % 3 = 0 or id % 100 = 1").select("url").unionByName(spark.createDataFrame([("http://h5.org/none",)], "url string"))
    sent = spark.sparkContext.accumulator(0)
    search = warc._searcher

    def counted(batches):
        def seen():
            for batch in batches:
                sent.add(batch.num_rows)
                yield batch

        return search(seen())

    monkeypatch.setattr(warc, "_searcher", counted)
    found = sorted(r.page_id for r in warc.lookup(asked, directory, folder).collect())
    assert found == [i for i in range(6000) if i % 3 == 0 or i % 100 == 1]
    urls = asked.distinct().count()
    assert urls < sent.value <= blocks + urls + 2 * 2 * 8


def test_only_repeated_payloads_are_shuffled(spark):
    """A very common payload and single ones stay where they lie; the rest is joined; all equal the plain way."""
    hot, rows = "h" * 1500, []
    for i in range(3000):
        rows.append((i, f"http://a.org/{i}", hot if i % 3 == 0 else "p" * 1200 + str(i // 4 if i % 7 == 0 else -i)))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    marked = warc.mark_revisits(frame)
    got = sorted(((r.page_id, r["size"], r.digest, "response" if r.refers_to is None else "revisit", r.refers_to) for r in marked.collect()), key=repr)
    assert got == _want([(i, h) for i, _, h in rows])
    assert marked.where("(payload is null) <> (refers_to is not null)").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = warc.mark_revisits(frame)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "LeftAnti" in plan and "LeftSemi" in plan
