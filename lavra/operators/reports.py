"""Corpus and tokenizer reports. Each is one aggregate; no length ever reaches the driver by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lavra.functions.tokens import CONTEXT_SIZE
from lavra.operators.cuts import every_kth
from lavra.operators.encoding import encode_documents, encode_tokens
from lavra.operators.filters import QualityRule, RULES
from lavra.operators.vocabulary import with_tokens
from lavra.session import fence


def fertility_per_document(docs: DataFrame, vocab: DataFrame, *, model="word", text="text"):
    """Pieces per pre-token of each document, without special tokens; 0 where there is none."""
    others = [c for c in docs.columns if c != text]
    tokens = with_tokens(docs, text=text)
    tokens = tokens.select(*others, "tokens", F.size("tokens").cast("long").alias("n_words"))
    coded = encode_tokens(tokens, vocab, model=model)
    return coded.select(
        *others, F.size("ids").cast("long").alias("n_subwords"), "n_words"
    ).withColumn("fertility", F.coalesce(F.try_divide("n_subwords", "n_words"), F.lit(0.0)))


def fertility_macro(per_document: DataFrame) -> DataFrame:
    """Mean and largest fertility of the documents; null for no documents."""
    return per_document.agg(
        F.avg("fertility").alias("avg_fertility"), F.max("fertility").alias("max_fertility")
    )


def fertility_micro(per_document: DataFrame, *, with_specials: bool = True) -> DataFrame:
    """All pieces over all pre-tokens; counts the two special tokens of each row when asked to."""
    extra = 2 if with_specials else 0
    return per_document.agg(
        F.sum(F.col("n_subwords") + extra).alias("generated"), F.sum("n_words").alias("original")
    ).withColumn("fertility", F.try_divide("generated", "original"))


def token_distribution(
    docs: DataFrame, vocab: DataFrame, *, threshold=1000, sample_ratio=0.01, model="word", key="doc_id"
) -> DataFrame:
    """Token counts (special tokens included) over a systematic sample."""
    sample = every_kth(docs, key=key, ratio=sample_ratio)
    lengths = encode_documents(sample, vocab, model=model).select(
        (F.size("ids") + 2).cast("long").alias("n")
    )
    report = lengths.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"),
        F.count_if(F.col("n") > threshold).alias("over_threshold"),
        F.max("n").alias("max_length"),
        F.avg("n").alias("avg_length"),
    )
    return report.withColumn("tokens_billions", F.col("tokens") / 1e9).withColumn(
        "percent_over", F.coalesce(F.try_divide(100.0 * F.col("over_threshold"), "documents"), F.lit(0.0))
    )


def sequence_length_report(
    rows: DataFrame, *, limit=CONTEXT_SIZE, good=1024, short=20, ids="input_ids"
) -> DataFrame:
    """Totals, spread and anomaly counts of row lengths.

    Exact percentiles merge counts per distinct length, of which there are at most the context size.
    """
    lengths = rows.select(F.size(ids).cast("long").alias("n"))
    report = lengths.agg(
        F.count("*").alias("sequences"),
        F.sum("n").alias("tokens"),
        F.avg("n").alias("mean_length"),
        F.min("n").alias("min_length"),
        F.max("n").alias("max_length"),
        F.percentile("n", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.99)))).alias("_p"),
        F.count_if(F.col("n") == limit).alias("at_limit"),
        F.count_if(F.col("n") > limit).alias("over_limit"),
        F.count_if(F.col("n") < short).alias("too_short"),
        F.count_if(F.col("n") > good).alias("good"),
    )
    names = ("p25", "median_length", "p75", "p90", "p99")
    picked = []
    for at, name in enumerate(names):
        value = F.get("_p", F.lit(at))
        picked.append((value if name == "median_length" else F.floor(value).cast("long")).alias(name))
    shares = [
        F.try_divide(c, "sequences").alias(f"{c}_share")
        for c in ("at_limit", "over_limit", "too_short", "good")
    ]
    return report.select(
        "sequences", "tokens", "mean_length", "min_length", "max_length", *picked,
        "at_limit", "over_limit", "too_short", "good", *shares,
    )


def word_count_histogram(
    measured: DataFrame, *, rule: QualityRule | str = "early", bins: int = 40
) -> DataFrame:
    """Equal-width histograms of ``num_words`` before and after a quality rule.

    The texts are read once: counts per distinct word number first, bins over those few rows after.
    """
    rule = RULES[rule] if isinstance(rule, str) else rule
    kept = F.coalesce(rule.condition(), F.lit(False))
    series = F.when(kept, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))
    counts = measured.select(F.explode(series).alias("series"), "num_words")
    counts = counts.groupBy("series", "num_words").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("series")
    low, high = F.min("num_words").over(whole), F.max("num_words").over(whole)
    placed = counts.withColumn("_low", low).withColumn("_high", high)
    at = F.floor((F.col("num_words") - F.col("_low")) * bins / F.nullif(F.col("_high") - F.col("_low"), F.lit(0)))
    placed = placed.withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int"))
    filled = placed.groupBy("series", "bin").agg(F.sum("n").alias("documents"))
    spark = measured.sparkSession
    empty = spark.range(bins).select(
        F.explode(F.array(F.lit("before"), F.lit("after"))).alias("series"),
        F.col("id").cast("int").alias("bin"),
    )
    return empty.join(filled, ["series", "bin"], "left").select(
        "series", "bin", F.coalesce("documents", F.lit(0)).cast("long").alias("documents")
    )
