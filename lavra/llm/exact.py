"""Exact duplicates by two passes of Bloom filtering.

The first pass sets one bit for every text in a sparse filter of 2^40 words of 64 bits. Only words that
occur are kept, merged by partial aggregates: eight bytes of a hash move, never a text. A word that got
more texts than it has bits set was hit twice at one bit, so its texts are possibly repeated. These words
make a second, dense filter of bounded size that goes to all tasks. The second pass tests every row with
it: the rows it rejects pass straight through, the others are grouped by the digest of their text. What
either filter lets through wrongly is found to be alone there, so neither affects the result. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lavra.session import new_scratch, stage

# The dense filter has 16 bits for each repeated word, up to 2^23 words of 64 bits (64 MB). Beyond some
# 33 million repeated texts it lets more rows through, which then are grouped as the repeated ones are.
LEAST_WORDS = 1 << 10
MOST_WORDS = 1 << 23
SEGMENT = 1 << 10

# A group with more than a thousandth of the rows to be grouped is sent to all tasks; there are at most a thousand.
HEAVY = 1_000


def _plain(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _word(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 24)


def _bit(hashed: Column, skip: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(hashed, skip).bitwiseAND(63)).cast("int"))


def repeated_words(docs: DataFrame, *, text="text") -> DataFrame:
    """First pass: words of the sparse filter that texts hit twice at one bit."""
    rows = docs.select(F.xxhash64(_plain(text)).alias("h")).select(F.shiftrightunsigned("h", 24).alias("word"), _bit(F.col("h"), 0).alias("bit"))
    hit = rows.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    return hit.where(F.col("n") > F.bit_count("bits")).select("word")


def _places(word: Column, words: int) -> tuple[Column, Column]:
    """The dense word of a hash, and the bits it sets there."""
    h = F.xxhash64(word, F.lit(11))
    bits = _bit(h, 30).bitwiseOR(_bit(h, 36)).bitwiseOR(_bit(h, 42)).bitwiseOR(_bit(h, 48))
    return h.bitwiseAND(words - 1), bits


def dense_filter(spark: SparkSession, repeated: DataFrame) -> tuple[DataFrame, int]:
    """Rows ``(segment, words)`` of 1,024 words each, and how many words there are, a power of two."""
    words, n = LEAST_WORDS, repeated.count()
    while words * 4 < n and words < MOST_WORDS:
        words *= 2
    place, bits = _places(F.col("word"), words)
    unset = spark.range(words).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("bits"))
    full = unset.unionByName(repeated.select(place.alias("place"), bits.alias("bits"))).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "bits")))
    segments = full.groupBy(F.floor(F.col("place") / SEGMENT).alias("segment")).agg(ordered.alias("w"))
    return segments.select("segment", F.col("w.bits").alias("words")), words


def tested(rows: DataFrame, word: str, filter: tuple[DataFrame, int], out: str) -> DataFrame:
    """Second pass: replace the column ``word`` by whether the dense filter holds it; no row moves."""
    segments, words = filter
    kept = [rows[c] for c in rows.columns if c != word]
    place, bits = _places(F.col(word), words)
    rows = rows.withColumns({f"{out}_place": place, f"{out}_bits": bits})
    held = segments.select(F.col("segment").alias(f"{out}_segment"), F.col("words").alias(f"{out}_words"))
    here = F.floor(F.col(f"{out}_place") / SEGMENT) == F.col(f"{out}_segment")
    at = F.get(F.col(f"{out}_words"), F.col(f"{out}_place").bitwiseAND(SEGMENT - 1).cast("int"))
    set_ = at.bitwiseAND(F.col(f"{out}_bits")) == F.col(f"{out}_bits")
    return rows.join(F.broadcast(held), here & set_, "left").select(*kept, F.col(f"{out}_segment").isNotNull().alias(out))


def _filter(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    repeated = stage(repeated_words(docs, text=text), "repeated")
    segments, words = dense_filter(docs.sparkSession, repeated)
    return stage(segments, "filter"), words


def exact_groups(docs: DataFrame, *, key="doc_id", text="text") -> DataFrame:
    """Per row: key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, the digest of the text.

    Rows are equal when their texts are, byte for byte; null counts as empty. The largest key of a group
    is its ``keep_id``, null if no row of it has a key, and ``kept`` marks the rows with that key: a row
    that repeats key and text is marked each time. Other columns are not read, so their names cannot
    clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), _plain(text).alias("t"))
    rows = rows.select("key", F.sha2("t", 256).alias("sha"), _word(F.col("t")).alias("word"))
    path = new_scratch(spark, "tested")
    passed = tested(rows, "word", _filter(docs, text), "possible")
    passed.write.partitionBy("possible").parquet(path)
    passed = spark.read.schema(passed.schema).parquet(path)
    alone, possible = passed.where(~F.col("possible")), passed.where("possible").drop("possible")

    groups = stage(possible.groupBy("sha").agg(F.max("key").alias("keep"), F.count("*").alias("n")), "groups")
    many = F.lit(possible.count()) < F.col("n") * HEAVY
    heavy = F.broadcast(groups.where(many))
    grouped = possible.join(heavy, "sha").unionByName(
        possible.join(heavy.select("sha"), "sha", "left_anti").join(groups.where(~many), "sha")
    )
    single = alone.select("sha", "key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("n"))
    return single.unionByName(grouped).select(
        F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("key").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_largest(docs: DataFrame, *, key="doc_id", text="text") -> DataFrame:
    """The rows of ``docs`` with one row of each group of equal texts, that with the largest key; all columns stay.

    Rows without a key go behind those with one; of rows equal in key and text the one whose columns hash
    highest stays. Rows that the filter rejects are not moved. Any column names may be there.
    """
    columns = docs.columns
    fresh = "possible"
    while any(c.lower().startswith(fresh) for c in columns):
        fresh = f"_{fresh}"
    word = f"{fresh}_word"
    passed = tested(docs.withColumn(word, _word(_plain(text))), word, _filter(docs, text), fresh)
    order = F.struct(F.col(key).isNotNull(), F.col(key), F.xxhash64(F.struct(*(F.col(f"`{c}`") for c in columns)).cast("string")))
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    best = passed.where(fresh).groupBy(F.sha2(_plain(text), 256).alias(f"{fresh}_sha")).agg(F.max_by(row, order).alias(fresh))
    return passed.where(~F.col(fresh)).select(*(F.col(f"`{c}`") for c in columns)).unionByName(best.select(f"{fresh}.*"))


GROUPS_SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM (
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
)
"""
