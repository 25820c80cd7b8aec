"""Cleaning, measures and quality rules over the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from lavra.functions import encodings, markup, text as tx
from lavra.operators import filters, measures, reports
from lavra.operators.vocabulary import normalize
from lavra.plans import fixtures as fx, sql as q
from lavra.plans.inputs import table
from lavra.plans.registry import query
from lavra.session import new_scratch
from lavra.streaming import ingest, stateful

_MEASURED = "num_words, stopwords, round(average, 6) AS average"


def _shown(df, *keys):
    return df.select(*keys, "num_words", "stopwords", F.round("average", 6).alias("average"))


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "text")


@query(
    "html_to_text",
    r"""
WITH shown AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
    '<(script|style)\b[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'gs') AS t
  FROM pages
)
SELECT page_id, md5(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS text_md5 FROM shown
""",
)
def html_to_text(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", F.md5(markup.strip_markup("html").cast("binary")).alias("text_md5"))


@query("html_to_text_escaped", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def html_to_text_escaped(spark, folder):
    """Documents written as markup must come back as they were."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<p>"), escaped, F.lit("</p><!-- end --><script>x('<b>')</script>"))
    return _docs(spark, folder).select("doc_id", F.md5(markup.strip_markup(page).cast("binary")).alias("text_md5"))


@query("fix_mojibake", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def fix_mojibake(spark, folder):
    """Documents whose UTF-8 was read as Latin-1 must come back as they were."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = _docs(spark, folder).select("doc_id", broken.alias("text"))
    return docs.select("doc_id", F.md5(tx.repair_text("text").cast("binary")).alias("text_md5"))


_CHAINS = [(e,) for e in encodings.ENCODINGS] + [(a, b) for a in encodings.ENCODINGS for b in encodings.ENCODINGS]


@F.arrow_udf(T.StringType())
def _damaged(texts: pa.Array, chains: pa.Array) -> pa.Array:
    out = []
    for text, chain in zip(texts.to_pylist(), chains.to_pylist()):
        for encoding in _CHAINS[chain] if text is not None else ():
            text = encodings.misread(text, encoding)
        out.append(text)
    return pa.array(out, pa.string())


@query("fix_mojibake_chains", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def fix_mojibake_chains(spark, folder):
    """Documents damaged by every chain of one or two wrong decodings must come back as they were."""
    chain = F.pmod(F.xxhash64("doc_id"), F.lit(len(_CHAINS))).cast("int")
    broken = _docs(spark, folder).select("doc_id", _damaged("text", chain).alias("text"))
    return broken.select("doc_id", F.md5(markup.repair_encoding("text").cast("binary")).alias("text_md5"))


@query("fix_mojibake_lines", "SELECT doc_id, md5(text || chr(10) || '日') AS text_md5 FROM documents")
def fix_mojibake_lines(spark, folder):
    """Documents with every second line damaged must come back as they were."""
    lines = F.split(F.concat("text", F.lit("\n日")), "\n")
    damaged = F.transform(lines, lambda x, i: F.when(i % 2 == 0, F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")).otherwise(x))
    # The last line cannot be read as single bytes, so no text is broken as a whole.
    kept = F.concat(F.slice(damaged, F.lit(1), F.size(lines) - 1), F.array(F.lit("日")))
    docs = _docs(spark, folder).select("doc_id", F.array_join(kept, "\n").alias("text"))
    return docs.select("doc_id", F.md5(tx.undo_mojibake("text").cast("binary")).alias("text_md5"))


@query(
    "flatten_paragraphs",
    f"SELECT doc_id, md5(text || {q.NL}) AS text_md5 FROM documents",
)
def flatten_paragraphs(spark, folder):
    docs = fx.nested_docs(spark, folder)
    return measures.join_paragraphs(docs).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("split_paragraphs", q.with_(q.LINES) + "SELECT doc_id, para_idx, text FROM lines")
def split_paragraphs(spark, folder):
    return measures.split_paragraphs(_docs(spark, folder)).select("doc_id", "para_idx", "text")


@query(
    "normalize_quotes",
    "SELECT doc_id, md5(replace(replace(replace(replace(text, ',', '``'), '.', ''''''), '``', '\"'), '''''', '\"')) "
    "AS text_md5 FROM documents",
)
def normalize_quotes(spark, folder):
    quoted = F.replace(F.replace(F.col("text"), F.lit(","), F.lit("``")), F.lit("."), F.lit("''"))
    docs = _docs(spark, folder).select("doc_id", quoted.alias("text"))
    return docs.select("doc_id", F.md5(tx.straight_quotes("text").cast("binary")).alias("text_md5"))


def _decomposed(spark, folder):
    """Accented letters taken apart into letter and combining mark."""
    text = F.col("text")
    acute, tilde, dots = chr(0x301), chr(0x303), chr(0x308)
    for whole, parts in (("é", "e" + acute), ("ó", "o" + acute), ("ñ", "n" + tilde), ("ü", "u" + dots)):
        text = F.replace(text, F.lit(whole), F.lit(parts))
    return _docs(spark, folder).select("doc_id", text.alias("text"))


_DECOMPOSED = (
    "replace(replace(replace(replace(text, 'é', 'e' || chr(769)), 'ó', 'o' || chr(769)), "
    "'ñ', 'n' || chr(771)), 'ü', 'u' || chr(776))"
)


@query("normalize_nfc", f"SELECT doc_id, md5(nfc_normalize({_DECOMPOSED})) AS text_md5 FROM documents")
def normalize_nfc(spark, folder):
    docs = _decomposed(spark, folder)
    return docs.select("doc_id", F.md5(markup.compose("text").cast("binary")).alias("text_md5"))


@query("normalize_text", f"SELECT doc_id, md5({q.normal(_DECOMPOSED)}) AS text_md5 FROM documents")
def normalize_text(spark, folder):
    docs = _decomposed(spark, folder)
    return docs.select("doc_id", F.md5(normalize("text").cast("binary")).alias("text_md5"))


@query("word_count", f"SELECT doc_id, len({q.words('text')})::BIGINT AS num_words FROM documents")
def word_count(spark, folder):
    return _docs(spark, folder).select("doc_id", F.size(tx.split_words("text")).cast("long").alias("num_words"))


@query(
    "stopword_count",
    f"SELECT doc_id, len(list_filter({q.words(q.fold('text'))}, lambda w: list_contains({q.STOP_CASE}, w)))::BIGINT "
    "AS stopwords FROM documents",
)
def stopword_count(spark, folder):
    return measures.measure_documents(_docs(spark, folder), min_words=0).select("doc_id", "stopwords")


@query(
    "avg_word_len",
    f"SELECT doc_id, round(list_sum(list_transform({q.words('text')}, lambda w: length(w)))::DOUBLE "
    f"/ nullif(len({q.words('text')}), 0), 6) AS average FROM documents",
)
def avg_word_len(spark, folder):
    measured = measures.measure_documents(_docs(spark, folder), min_words=0)
    return measured.select("doc_id", F.round("average", 6).alias("average"))


@query("metrics_document", q.with_(q.DOC_MEASURES) + f"SELECT doc_id, md5(text) AS text_md5, {_MEASURED} FROM measured")
def metrics_document(spark, folder):
    measured = measures.measure_documents(_docs(spark, folder))
    digest = F.md5(F.col("text").cast("binary")).alias("text_md5")
    return _shown(measured.withColumn("text_md5", digest), "doc_id", "text_md5")


@query(
    "metrics_paragraph",
    q.with_(q.PARA_MEASURES) + f"SELECT doc_id, para_idx, text AS paragraph, {_MEASURED} FROM measured",
)
def metrics_paragraph(spark, folder):
    measured = measures.measure_paragraphs(_docs(spark, folder))
    return _shown(measured.withColumnRenamed("text", "paragraph"), "doc_id", "para_idx", "paragraph")


@query(
    "stopword_table",
    "WITH stops AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS lang, unnest({q.text_list(v)}) AS word" for k, v in q.STOPWORDS.items())
    + f"), uses AS (SELECT lang, word, count(*) AS uses FROM (SELECT lang, unnest({q.words(q.fold('text'))}) AS word "
    "FROM documents) GROUP BY ALL) SELECT lang, word, coalesce(uses, 0)::BIGINT AS uses FROM stops LEFT JOIN uses "
    "USING (lang, word)",
)
def stopword_table(spark, folder):
    return measures.stopword_usage(_docs(spark, folder))


def _rule_sql(words: str, stop: int, low: int, high: int) -> str:
    return f"WHERE num_words {words} AND stopwords >= {stop} AND average BETWEEN {low} AND {high}"


def _paragraph_rule(name: str, condition: str):
    sql = q.with_(q.PARA_MEASURES) + f"SELECT doc_id, para_idx, {_MEASURED} FROM measured {condition}"

    @query(f"quality_{name}", sql)
    def run(spark, folder):
        measured = measures.measure_paragraphs(_docs(spark, folder))
        return _shown(filters.apply_rule(measured, name), "doc_id", "para_idx")

    return run


_paragraph_rule("phase1", _rule_sql("BETWEEN 20 AND 1024", 2, 2, 15))
_paragraph_rule("early", _rule_sql("BETWEEN 20 AND 512", 1, 2, 15))
_paragraph_rule("short", _rule_sql(">= 10 AND num_words < 20", 2, 3, 10))


@query(
    "quality_phase2",
    q.with_(q.DOC_MEASURES) + f"SELECT doc_id, {_MEASURED} FROM measured {_rule_sql('>= 100', 2, 2, 15)}",
)
def quality_phase2(spark, folder):
    return _shown(filters.apply_rule(measures.measure_documents(_docs(spark, folder)), "phase2"), "doc_id")


@query(
    "min_words_drop",
    f"WITH {q.LINES} SELECT 'document' AS level, doc_id, -1 AS para_idx FROM documents "
    f"WHERE len({q.words('text')}) >= 100 UNION ALL SELECT 'paragraph', doc_id, para_idx FROM lines "
    f"WHERE len({q.words('text')}) >= 2",
)
def min_words_drop(spark, folder):
    docs = _docs(spark, folder)
    whole = measures.drop_short(docs, 100)
    lines = measures.drop_short(measures.split_paragraphs(docs), 2)
    none = F.lit(-1).alias("para_idx")
    return whole.select(F.lit("document").alias("level"), "doc_id", none).unionByName(
        lines.select(F.lit("paragraph").alias("level"), "doc_id", "para_idx")
    )


@query(
    "quality_by_language",
    q.with_(q.DOC_MEASURES)
    + "SELECT lang, count(*) AS documents, sum(num_words)::BIGINT AS words, round(avg(num_words), 6) AS avg_words "
    f"FROM measured {_rule_sql('>= 100', 2, 2, 15)} GROUP BY lang",
)
def quality_by_language(spark, folder):
    """How much text of each language survives the active rule."""
    good = filters.apply_rule(measures.measure_documents(_docs(spark, folder)), "phase2")
    return good.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.sum("num_words").alias("words"),
        F.round(F.avg("num_words"), 6).alias("avg_words"),
    )


@query(
    "num_words_histogram",
    q.with_(
        q.PARA_MEASURES,
        f"""two AS (
  SELECT 'before' AS series, num_words FROM measured UNION ALL
  SELECT 'after', num_words FROM measured {_rule_sql('BETWEEN 20 AND 512', 1, 2, 15)}
)""",
        "ends AS (SELECT series, min(num_words) AS lo, max(num_words) AS hi FROM two GROUP BY series)",
        """binned AS (
  SELECT series, coalesce(least(floor((num_words - lo) * 40 / nullif(hi - lo, 0)), 39), 0)::INT AS bin, count(*) AS n
  FROM two JOIN ends USING (series) GROUP BY ALL
)""",
    )
    + "SELECT s AS series, b::INT AS bin, coalesce(n, 0)::BIGINT AS documents "
    "FROM (SELECT unnest(['before', 'after']) AS s) CROSS JOIN range(40) r(b) "
    "LEFT JOIN binned ON series = s AND bin = b",
)
def num_words_histogram(spark, folder):
    measured = measures.measure_paragraphs(_docs(spark, folder))
    return reports.word_count_histogram(measured, rule="early")


@query(
    "stream_curate",
    q.with_(q.DOC_MEASURES) + f"SELECT doc_id, {_MEASURED} FROM measured {_rule_sql('>= 100', 2, 2, 15)}",
)
def stream_curate(spark, folder):
    """The stored result of a stream over the files equals the batch result."""
    out = new_scratch(spark, "stream")
    arriving = ingest.read_arriving(spark, f"{folder}/documents*.parquet")
    kept = _shown(ingest.curate(arriving), "doc_id")
    ingest.write_new(kept, f"{out}/table", f"{out}/progress").awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{out}/table")


_TESTED = f"CASE WHEN substr(md5('42:' || doc_id::VARCHAR), 1, 8) < '{int(0.1 * 2**32):08x}' THEN 'test' ELSE 'train' END AS split"


@query(
    "stream_each_once",
    q.with_(q.DOC_MEASURES) + f"SELECT DISTINCT doc_id, {_MEASURED}, {_TESTED} FROM measured {_rule_sql('>= 100', 2, 2, 15)}",
)
def stream_each_once(spark, folder):
    """All files arrive twice; each document is kept once, with its split."""
    out = new_scratch(spark, "stream")
    files = f"{folder}/documents*.parquet"
    arriving = ingest.read_arriving(spark, files).unionByName(ingest.read_arriving(spark, files))
    split = stateful.arrival_split("doc_id", share=0.1, seed=42).alias("split")
    kept = stateful.each_once(_shown(ingest.curate(arriving), "doc_id")).select("*", split)
    ingest.write_new(kept, f"{out}/table", f"{out}/progress").awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{out}/table")


@query(
    "stream_running_totals",
    q.with_(q.DOC_MEASURES)
    + "SELECT lang, count(*) AS n_rows, sum(num_words)::BIGINT AS num_words, sum(stopwords)::BIGINT AS stopwords "
    f"FROM measured {_rule_sql('>= 100', 2, 2, 15)} GROUP BY lang",
)
def stream_running_totals(spark, folder):
    """Documents and words of each language, kept up as files arrive."""
    out = new_scratch(spark, "stream")
    kept = ingest.curate(ingest.read_arriving(spark, f"{folder}/documents*.parquet"))
    sums = ["num_words", "stopwords"]
    totals = stateful.running_totals(kept, by="lang", sums=sums, spread_by="doc_id")
    ingest.write_new(totals, f"{out}/table", f"{out}/progress").awaitTermination()
    written = spark.read.schema(totals.schema).parquet(f"{out}/table")
    return stateful.latest_totals(written, by="lang", sums=sums)


_RENAMED = "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'it' ELSE lang END"


@query(
    "quality_unlisted_languages",
    q.with_(q.DOC_MEASURES.replace("FROM documents", f"FROM (SELECT * REPLACE ({_RENAMED} AS lang) FROM documents)"))
    + f"SELECT lang, count(*) AS documents FROM measured {_rule_sql('>= 100', 2, 2, 15)} GROUP BY lang",
)
def quality_unlisted_languages(spark, folder):
    docs = _docs(spark, folder).withColumn("lang", F.expr(_RENAMED))
    kept = filters.apply_rule(measures.measure_documents(docs), "phase2")
    return kept.groupBy("lang").agg(F.count("*").alias("documents"))
