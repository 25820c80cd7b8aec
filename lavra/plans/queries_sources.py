"""Sources, sinks, projections, set operations, splits and samples over the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from lavra.operators import cuts, scores
from lavra.plans import fixtures as fx, sql as q
from lavra.plans.inputs import table
from lavra.plans.registry import query
from lavra.session import new_scratch, spread
from lavra.sources import corpora, event_logs, metric_logs, storage

def _digest():
    return F.md5(F.col("text").cast("binary")).alias("text_md5")


_DOCS = "SELECT doc_id, md5(text) AS text_md5 FROM documents"


@query("scan_documents", "SELECT doc_id, source, n_chars, md5(text) AS text_md5 FROM documents WHERE lang = 'en'")
def scan_documents(spark, folder):
    docs = spread(corpora.scan_documents(spark, f"{folder}/documents.parquet", lang="en"))
    return docs.select("doc_id", "source", "n_chars", _digest())


@query(
    "scan_nested",
    f"SELECT doc_id, len(string_split(text, {q.NL}))::BIGINT AS n_paragraphs, "
    f"length(replace(text, {q.NL}, ''))::BIGINT AS n_chars FROM documents",
)
def scan_nested(spark, folder):
    path = new_scratch(spark, "nested")
    fx.nested_docs(spark, folder).write.parquet(path)
    docs = corpora.scan_nested(spark, path)
    lines = F.flatten("text.paragraphs")
    return docs.select(
        "doc_id",
        F.size("text.paragraphs").cast("long").alias("n_paragraphs"),
        F.length(F.array_join(lines, "")).cast("long").alias("n_chars"),
    )


def _all_texts(spark, folder):
    key = {
        "documents": F.col("doc_id").cast("string"),
        "pages": F.col("page_id").cast("string"),
        "conversations": F.concat_ws("-", "conv_id", "turn"),
        "benchmark": F.col("item_id").cast("string"),
    }
    text = {"pages": "html"}
    return [
        table(spark, folder, name).select(
            F.lit(name).alias("origin"), k.alias("doc_id"), F.col(text.get(name, "text")).alias("text")
        )
        for name, k in key.items()
    ]


_ALL_TEXTS = """
SELECT 'documents' AS origin, doc_id::VARCHAR AS doc_id, text FROM documents
UNION ALL SELECT 'pages', page_id::VARCHAR, html FROM pages
UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT 'benchmark', item_id::VARCHAR, text FROM benchmark
"""


@query("load_all_sources", f"SELECT origin, doc_id, md5(text) AS text_md5 FROM ({_ALL_TEXTS})")
def load_all_sources(spark, folder):
    return corpora.union_sources(_all_texts(spark, folder), ("origin", "doc_id", "text")).select(
        "origin", "doc_id", _digest()
    )


@query("concat_sources", f"SELECT md5(text) AS text_md5, count(*) AS copies FROM ({_ALL_TEXTS} UNION ALL {_ALL_TEXTS}) GROUP BY 1")
def concat_sources(spark, folder):
    once = _all_texts(spark, folder)
    both = corpora.union_sources(once + once, ("text",))
    return both.groupBy(_digest()).agg(F.count("*").alias("copies"))


@query(
    "head_percent",
    f"{_DOCS} QUALIFY row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.05 + 0.5)",
)
def head_percent(spark, folder):
    return cuts.head_percent(table(spark, folder, "documents"), percent=5).select("doc_id", _digest())


@query(
    "head_percent_text_key",
    "SELECT k AS place, md5(text) AS text_md5 FROM (SELECT source || '/' || md5(text) || '/' || doc_id AS k, text FROM documents) "
    "QUALIFY row_number() OVER (ORDER BY k) <= floor(count(*) OVER () * 0.05 + 0.5)",
)
def head_percent_text_key(spark, folder):
    """The head of the corpus in the order of a text key."""
    docs = table(spark, folder, "documents")
    place = F.concat_ws("/", "source", F.md5(F.col("text").cast("binary")), F.col("doc_id").cast("string"))
    return cuts.head_percent(docs.withColumn("place", place), key="place", percent=5).select("place", _digest())


@query("scan_jsonl", "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents")
def scan_jsonl(spark, folder):
    path = new_scratch(spark, "jsonl")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    docs.write.option("compression", "gzip").json(path)
    return corpora.scan_json_lines(spark, f"{path}/*.json.gz").select("doc_id", "lang", "source", _digest())


def _text_files(path: str):
    """Write each text of a task as a file of its own, by key; texts that repeat a key in a task are lines of one.

    The files of a task share a folder and are written where they stay, so that nothing is moved afterwards
    and few folders are listed. A task that is run again writes the same files again.
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        folder = f"{root}/texts-{TaskContext.get().partitionId():05d}"
        store.create_dir(folder)
        seen, written = set(), 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                name, line = f"{folder}/doc_id={key}.txt", f"{text or ''}\n".encode()
                if key in seen:
                    with store.open_input_stream(name) as earlier:
                        line = earlier.read() + line
                with store.open_output_stream(name) as out:
                    out.write(line)
                seen.add(key)
                written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    return write


@query(
    "scan_text_files",
    f"SELECT doc_id, (length(text) + 1)::BIGINT AS n_chars, md5(text || {q.NL}) AS text_md5 FROM documents",
)
def scan_text_files(spark, folder):
    """One file per document, beside a file of another kind that must be skipped."""
    path = new_scratch(spark, "text-files")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs.mapInArrow(_text_files(path), "files long").agg(F.sum("files")).collect()
    docs.select("doc_id").write.mode("append").json(path)
    files = corpora.scan_text_files(spark, path)
    number = F.regexp_extract("file_path", r"doc_id=(\d+)", 1).cast("long")
    return files.select(number.alias("doc_id"), F.length("text").cast("long").alias("n_chars"), _digest())


@query(
    "scan_tagged",
    q.with_(fx.TAGGED)
    + f"SELECT id, {q.joined('tokens')} AS words, {q.joined('ner_tags')} AS tags, split FROM tagged",
)
def scan_tagged(spark, folder):
    path = new_scratch(spark, "tagged")
    storage.save(fx.tagged_words(spark, folder), path)
    rows = corpora.scan_tagged(spark, path)
    tags = F.array_join(F.col("ner_tags").cast("array<string>"), " ")
    return rows.select("id", F.array_join("tokens", " ").alias("words"), tags.alias("tags"), "split")


@query(
    "scan_pairs",
    q.with_(fx.PAIRS)
    + "SELECT sentence_pair_id, md5(premise) AS premise_md5, md5(hypothesis) AS hypothesis_md5, "
    "relatedness_score, entailment_judgment, split FROM pairs",
)
def scan_pairs(spark, folder):
    path = new_scratch(spark, "pairs")
    storage.save(fx.pairs(spark, folder), path)
    rows = corpora.scan_pairs(spark, path)
    return rows.select(
        "sentence_pair_id",
        F.md5(F.col("premise").cast("binary")).alias("premise_md5"),
        F.md5(F.col("hypothesis").cast("binary")).alias("hypothesis_md5"),
        "relatedness_score", "entailment_judgment", "split",
    )


_RANKED = """
SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rn, count(*) OVER () AS total FROM documents
"""
_SPLIT = f"""
SELECT doc_id, text, CASE WHEN rn <= ceil(0.1::DOUBLE * total) THEN 'test' ELSE 'train' END AS split
FROM ({_RANKED})
"""


def _split_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return cuts.train_test_split(docs, test_size=0.1, seed=42)


@query("train_test_split", f"SELECT doc_id, split FROM ({_SPLIT})")
def train_test_split(spark, folder):
    return _split_docs(spark, folder).select("doc_id", "split")


@query(
    "shuffled_fraction",
    f"SELECT doc_id, md5(text) AS text_md5 FROM ({_RANKED}) WHERE rn <= floor(0.05::DOUBLE * total)",
)
def shuffled_fraction(spark, folder):
    docs = table(spark, folder, "documents")
    return cuts.shuffled_fraction(docs, fraction=0.05, seed=42).select("doc_id", _digest())


@query("systematic_sample", f"{_DOCS} QUALIFY (row_number() OVER (ORDER BY doc_id) - 1) % 100 = 0")
def systematic_sample(spark, folder):
    return cuts.every_kth(table(spark, folder, "documents"), ratio=0.01).select("doc_id", _digest())


@query("reload_split", f"SELECT doc_id, md5(text) AS text_md5 FROM ({_SPLIT}) WHERE split = 'train'")
def reload_split(spark, folder):
    path = new_scratch(spark, "split")
    storage.save(_split_docs(spark, folder), path)
    return corpora.reload(spark, path, split="train").select("doc_id", _digest())


@query("sink_roundtrip", f"SELECT doc_id, md5(text) AS text_md5, split FROM ({_SPLIT})")
def sink_roundtrip(spark, folder):
    stored = storage.save(_split_docs(spark, folder), new_scratch(spark, "sink"))
    return stored.select("doc_id", _digest(), "split")


@query("materialize_reuse", f"SELECT doc_id, md5(text) AS text_md5, split FROM ({_SPLIT})")
def materialize_reuse(spark, folder):
    """The second call finds the stored table and must not build again."""
    path = new_scratch(spark, "reuse")
    storage.materialize(spark, lambda: _split_docs(spark, folder), path)

    def never():
        raise AssertionError("the stored table was not used")

    return storage.materialize(spark, never, path).select("doc_id", _digest(), "split")


@query(
    "merge_splits",
    f"SELECT origin, doc_id, split FROM (SELECT 'documents' AS origin, doc_id, split FROM ({_SPLIT}) UNION ALL "
    "SELECT 'pages', page_id, CASE WHEN rn <= ceil(0.1::DOUBLE * total) THEN 'test' ELSE 'train' END FROM "
    "(SELECT *, row_number() OVER (ORDER BY md5('42:' || page_id)) AS rn, count(*) OVER () AS total FROM pages))",
)
def merge_splits(spark, folder):
    first = _split_docs(spark, folder).withColumn("origin", F.lit("documents"))
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    second = cuts.train_test_split(pages).withColumn("origin", F.lit("pages"))
    return corpora.union_sources([first, second], ("origin", "doc_id", "split"))


@query("project_text", "SELECT doc_id, text FROM documents")
def project_text(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.drop(*[c for c in docs.columns if c not in ("doc_id", "text")])


@query("drop_columns", "SELECT doc_id, lang, text FROM documents")
def drop_columns(spark, folder):
    return table(spark, folder, "documents").drop("source", "n_chars")


@query("rename_columns", "SELECT doc_id, text AS paragraphs, lang AS language FROM documents")
def rename_columns(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return docs.withColumnRenamed("text", "paragraphs").withColumnRenamed("lang", "language")


@query("head_rows", "SELECT doc_id, substr(text, 1, 100) AS preview FROM documents ORDER BY doc_id LIMIT 10")
def head_rows(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.orderBy("doc_id").limit(10).select("doc_id", F.substring("text", 1, 100).alias("preview"))


@query("tail_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id DESC LIMIT 10")
def tail_rows(spark, folder):
    return table(spark, folder, "documents").orderBy(F.desc("doc_id")).limit(10).select("doc_id", "n_chars")


@query(
    "label_lookup",
    q.with_(fx.TAGGED)
    + f"SELECT {q.text_list(fx.TAGS)}[tag + 1] AS tag_name, split, count(*) AS words "
    "FROM (SELECT split, unnest(ner_tags) AS tag FROM tagged) GROUP BY ALL",
)
def label_lookup(spark, folder):
    rows = fx.tagged_words(spark, folder).select("split", F.explode("ner_tags").alias("label"))
    named = scores.with_label_names(rows, scores.label_table(spark, fx.TAGS), out="tag_name")
    return named.groupBy("tag_name", "split").agg(F.count("*").alias("words"))


@query("scan_metric_csv", "SELECT event_id AS step, value FROM events")
def scan_metric_csv(spark, folder):
    path = new_scratch(spark, "csv")
    events = table(spark, folder, "events")
    events.select(F.col("event_id").alias("Step"), F.col("value").alias("Value")).write.option(
        "header", True
    ).csv(path)
    rows = metric_logs.scan_metric_csv(spark, path)
    return rows.select(F.col("Step").alias("step"), F.col("Value").alias("value"))


@query(
    "metric_series",
    q.with_(fx.METRIC_LOG)
    + "SELECT run_id, step, value FROM metric_log WHERE tag = 'purchase' AND step > 1000",
)
def metric_series(spark, folder):
    return metric_logs.metric_series(fx.metric_log(spark, folder), "purchase", after_step=1000)


@query("metric_tags", "SELECT DISTINCT event_type AS tag FROM events")
def metric_tags(spark, folder):
    return metric_logs.metric_tags(fx.metric_log(spark, folder))


@query(
    "latest_run",
    q.with_(fx.METRIC_LOG)
    + "SELECT parent, run_id, tag, step, value FROM metric_log WHERE (parent, run_id) IN ("
    "SELECT (parent, run_id) FROM (SELECT parent, run_id, row_number() OVER "
    "(PARTITION BY parent ORDER BY run_ts DESC, run_id DESC) AS r FROM metric_log) WHERE r = 1)",
)
def latest_run(spark, folder):
    newest = metric_logs.latest_run(fx.metric_log(spark, folder))
    return newest.select("parent", "run_id", "tag", "step", "value")


def _event_logs(spark, folder):
    """The metric log written as event-log files, one per run, and read back."""
    path = new_scratch(spark, "event-logs")
    event_logs.write_event_logs(fx.metric_log(spark, folder), path)
    return event_logs.scan_event_logs(spark, path)


_STORED_LOG = fx.METRIC_LOG + ", stored AS (SELECT parent, run_id, run_ts, tag, step, value::FLOAT::DOUBLE AS value FROM metric_log WHERE value IS NOT NULL)"


@query("scan_event_logs", f"WITH {_STORED_LOG} SELECT parent, run_id, epoch_us(run_ts)::BIGINT AS wall_us, tag, step, value FROM stored")
def scan_event_logs(spark, folder):
    rows = _event_logs(spark, folder)
    return rows.select("parent", "run_id", F.unix_micros("run_ts").alias("wall_us"), "tag", "step", "value")


@query("event_log_tags", f"WITH {_STORED_LOG} SELECT DISTINCT tag FROM stored")
def event_log_tags(spark, folder):
    return metric_logs.metric_tags(_event_logs(spark, folder))


@query(
    "event_log_latest_run",
    f"WITH {_STORED_LOG} SELECT parent, run_id, tag, step, value FROM stored WHERE (parent, run_id) IN ("
    "SELECT parent, run_id FROM (SELECT parent, run_id, row_number() OVER "
    "(PARTITION BY parent ORDER BY run_ts DESC, run_id DESC) AS r FROM stored) WHERE r = 1)",
)
def event_log_latest_run(spark, folder):
    newest = metric_logs.latest_run(_event_logs(spark, folder))
    return newest.select("parent", "run_id", "tag", "step", "value")
