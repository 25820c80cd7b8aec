"""Word count, stop-word count and mean word length, per document or per paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lavra.functions.markup import clean_each
from lavra.functions.stopwords import STOPWORDS
from lavra.functions.text import (
    count_stopwords,
    fold_case,
    split_words,
    stopword_hits,
    trim_space,
)
from lavra.session import fence


def _measure(df: DataFrame, text: str, min_words: int, stopwords, lang) -> DataFrame:
    """One split per text. Short texts leave before the dearer measures are taken.

    The text is folded as one string before the split, which is far cheaper than folding each word.
    Folding may change the number of letters but not of spaces, and what the folded text has beyond its
    words is spaces; so the letters of the unfolded words come out without a second split.
    """
    kept = df.columns
    folded = fence(df, fold_case(text).alias("_folded"))
    words = fence(folded, split_words("_folded").alias("_words"))
    words = words.where(F.size("_words") >= min_words)
    spaces = F.length("_folded") - F.length(F.array_join("_words", ""))
    measured = fence(
        words,
        F.size("_words").cast("long").alias("num_words"),
        count_stopwords("_words", stopwords, lang).alias("stopwords"),
        (F.length(text) - spaces).cast("long").alias("_chars"),
        keep=kept,
    )
    return measured.withColumn("average", F.try_divide("_chars", "num_words")).drop("_chars")


def measure_documents(
    docs: DataFrame, *, text="text", lang="lang", min_words=100, stopwords=STOPWORDS
) -> DataFrame:
    """One row per document of at least ``min_words`` words, with its measures. Narrow: no shuffle."""
    return _measure(docs, text, min_words, stopwords, lang)


def split_paragraphs(docs: DataFrame, *, text="text") -> DataFrame:
    """One row per line of each text, trimmed, with its position."""
    others = [c for c in docs.columns if c != text]
    lines = docs.select(*others, F.posexplode(F.split(text, "\n")).alias("para_idx", "_line"))
    return lines.select(*others, "para_idx", trim_space("_line").alias(text))


def measure_paragraphs(
    docs: DataFrame, *, text="text", lang="lang", min_words=2, stopwords=STOPWORDS
) -> DataFrame:
    """One row per paragraph of at least ``min_words`` words, with its measures."""
    return _measure(split_paragraphs(docs, text=text), text, min_words, stopwords, lang)


def stopword_usage(docs: DataFrame, *, text="text", lang="lang", stopwords=STOPWORDS) -> DataFrame:
    """The stop-word table (distinct words per language) and how often each occurs in the texts.

    Only stop words leave a text, and they are summed map-side, so the one shuffle carries a list's worth
    of rows per task.
    """
    pairs = [(code, w.casefold()) for code, ws in stopwords.items() for w in ws]
    table = docs.sparkSession.createDataFrame(pairs, "lang string, word string").distinct()
    words = fence(docs, split_words(fold_case(text)).alias("_words"), keep=[lang])
    hits = stopword_hits("_words", stopwords, lang)
    words = words.select(F.col(lang).alias("lang"), F.explode(hits).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("uses"))
    joined = table.join(counted, ["lang", "word"], "left")
    return joined.select("lang", "word", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))


def drop_short(docs: DataFrame, min_words: int, *, text="text") -> DataFrame:
    """Rows of at least ``min_words`` words."""
    return docs.where(F.size(split_words(text)) >= min_words)


def join_paragraphs(nested: DataFrame, *, text="text", clean: bool = True) -> DataFrame:
    """Nested paragraphs as one text: every string cleaned and followed by a newline."""
    others = [c for c in nested.columns if c != text]
    strings = fence(nested, F.flatten(f"{text}.paragraphs").alias("_strings"), keep=others)
    cleaned = clean_each("_strings") if clean else F.col("_strings")
    whole = F.array_join(F.transform(cleaned, lambda s: F.concat(s, F.lit("\n"))), "")
    return strings.select(*others, whole.alias(text))
