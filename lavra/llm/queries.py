"""One registered query per operation, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lavra.llm import boosting, contamination, conversations, discriminant, exact, langid, lexical, licenses, minhash, packing, pii, secrets, statistics, warc
from lavra.session import bound_batches, stage
from lavra.plans.registry import query


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out() -> Column:
    """Rows that no model may learn from. A row without a key is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = langid.fit(learnable(docs))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _measured(docs: DataFrame) -> DataFrame:
    """Statistics of all documents, written once for learning and scoring."""
    return stage(docs.select("doc_id", statistics.measured("text").alias("s")).select("doc_id", "s.*"), "statistics")


def _labelled(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    return learnable(rows).join(read(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = _measured(read(spark, folder, "documents"))
    model = discriminant.fit(_labelled(rows.select("doc_id", "features"), spark, folder))
    found = rows.select("doc_id", held_out().alias("held_out"), discriminant.scored(model, "features").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = _measured(read(spark, folder, "documents"))
    model = boosting.fit(_labelled(rows.select("doc_id", "features"), spark, folder))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = rows.select("doc_id", *base, failed.alias("base_failed"), boosting.scored(model, "features").alias("score"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))


@query("op4_license_scan", licenses.scan_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(read(spark, folder, "documents"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_scan(read(spark, folder, "documents"))
    counts = [secrets.count_of("base", kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    base = F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secrets.span_text(F.concat("base", "more")).alias("spans"))


# A user gives a secret of their own; this one only makes the query repeatable.
QUERY_KEY = b"pseudonym key of the registered query"


@query("op5_pii_pseudonyms")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, QUERY_KEY)


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, read(spark, folder, "benchmark"))
    return found.select("doc_id", F.inline("hits"))


@query("op10_warc_index")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    directory, archive = warc.write_archives(warc.mark_revisits(pages))
    # All URLs are looked up, nulls by their empty key, so each capture comes through the index.
    records = warc.read_records(warc.lookup(pages.select("url"), directory, archive), archive)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_exact_dedup", exact.GROUPS_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(read(spark, folder, "documents"))


@query("op12_lexical_search", lexical.BEST_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.best_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(read(spark, folder, "conversations"))
