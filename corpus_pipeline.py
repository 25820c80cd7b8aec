"""A corpus pipeline: documents to packed token sequences in five stored stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lavra.llm import contamination, langid, minhash, packing, pii
from lavra.llm.queries import QUERY_KEY, bound_batches, learnable, read
from lavra.plans.registry import query
from lavra.session import new_scratch, ship_package


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language prediction is not rejected; the model learns from the documents themselves."""
    _prepare(spark)
    model = langid.fit(learnable(docs))
    return langid.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of five-word shingles), that with the smallest id.

    Of rows that repeat an id with the same text one stays, and one of near copies that have no id.
    """
    _prepare(spark)
    return minhash.keep_one(docs, threshold=80).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _prepare(spark)
    found = contamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; ``n_chars`` follows the new text."""
    _prepare(spark)
    changed = pii.pseudonymize(docs, QUERY_KEY)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids with the documents in each."""
    _prepare(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.sequences(packing.pack(pieces))


STAGES = [
    ("language_id", keep_known_language),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

# Models, edit distances and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = new_scratch(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
