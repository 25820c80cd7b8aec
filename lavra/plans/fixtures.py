"""Task tables that Spark derives from the given tables, with the same rules as SQL.

The given tables hold no tags, pairs or predictions; these rules make them from hashes, over all rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lavra.plans.inputs import table
from lavra.functions.text import split_words
from lavra.operators.measures import split_paragraphs
from lavra.plans import sql as q
from lavra.session import fence

TAGS = ["O", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]
_TAG_LIST = T.ArrayType(T.IntegerType())


def _hash(*columns):
    return F.md5(F.concat(*columns).cast("binary"))


def _digit(hashed, at: int):
    """One hexadecimal digit of a hash as a number."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(hashed, at, 1)) - 1


def _place_hashes(before: str, ids: list[str], sizes: np.ndarray) -> np.ndarray:
    """The first three hexadecimal digits of the hash of each place of each row, rows one after the other."""
    places = [b"%d" % n for n in range(sizes.max(initial=0))]
    found = []
    for id_, size in zip(ids, sizes.tolist()):
        head = f"{before}{id_}:".encode()
        found.append(b"".join([hashlib.md5(head + place).digest()[:2] for place in places[:size]]))
    first = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 2).astype(np.int32)
    return np.stack([first[:, 0] >> 4, first[:, 0] & 15, first[:, 1] >> 4])


def _lists(values, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


@F.arrow_udf(T.StructType([T.StructField("logits", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("labels", _TAG_LIST)]))
def _tag_scores(ids: pa.Array, tags: pa.Array) -> pa.Array:
    """Scores and labels of the places of each row, by another hash of row and place."""
    sizes = tags.value_lengths().to_numpy(zero_copy_only=False)
    tag = tags.flatten().to_numpy(zero_copy_only=False)
    wrong, sure, ignored = _place_hashes("t:", ids.to_pylist(), sizes)
    table = np.zeros((len(tag), len(TAGS)))
    table[np.arange(len(tag)), np.where(wrong < 2, (tag + 1) % 5, tag)] = 1 + sure / 16.0
    scores = _lists(pa.array(table.ravel()), np.full(len(tag), len(TAGS)))
    labels = pa.array(np.where(ignored == 0, -100, tag), pa.int32())
    return pa.StructArray.from_arrays([_lists(scores, sizes), _lists(labels, sizes)], ["logits", "labels"])


def _sql_digit(hashed: str, at: int) -> str:
    return f"('0x' || substr({hashed}, {at}, 1))::INT"


def nested_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Every line becomes a paragraph list of one string."""
    docs = table(spark, folder, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x: F.array(x))
    return docs.select("doc_id", F.struct(lines.alias("paragraphs")).alias("text"))


def tagged_words(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-empty line is a sentence; tags come from the hash of sentence and position."""
    lines = split_paragraphs(table(spark, folder, "documents").select("doc_id", "text"))
    words = fence(
        lines,
        F.concat_ws("-", "doc_id", "para_idx").alias("id"),
        split_words("text").alias("tokens"),
        keep=["doc_id"],
    ).where(F.size("tokens") > 0)

    def tag(word, at):
        return F.least(_digit(_hash(F.col("id"), F.lit(":"), at.cast("string")), 1), F.lit(8)) % 5

    return words.select(
        "id",
        "tokens",
        F.transform("tokens", tag).alias("ner_tags"),
        F.when(_hash(F.col("doc_id").cast("string")) < "2", "test").otherwise("train").alias("split"),
    )


TAGGED = f"""
{q.LINES},
tagged AS (
  SELECT id, tokens, split,
         list_transform(tokens, lambda w, i: least({_sql_digit("md5(id || ':' || (i - 1))", 1)}, 8) % 5) AS ner_tags
  FROM (
    SELECT doc_id || '-' || para_idx AS id, {q.words('text')} AS tokens,
           CASE WHEN md5(doc_id::VARCHAR) < '2' THEN 'test' ELSE 'train' END AS split FROM lines
  ) WHERE len(tokens) > 0
)
"""


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn with the turn after it. Joined on (conversation, turn), so a long one is no hot key."""
    turns = table(spark, folder, "conversations")
    first = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("premise"))
    second = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    both = first.join(second, ["conv_id", "turn"])
    key = F.col("conv_id") * 1000 + F.col("turn")
    hashed = _hash(key.cast("string"))
    return both.select(
        key.alias("sentence_pair_id"),
        "premise",
        "hypothesis",
        (1 + _digit(hashed, 1) / F.lit(4.0)).alias("relatedness_score"),
        (_digit(hashed, 2) % 2).alias("entailment_judgment"),
        F.when(hashed < "2", "test").otherwise("train").alias("split"),
    )


PAIRS = f"""
pairs AS (
  SELECT k AS sentence_pair_id, premise, hypothesis,
         1 + {_sql_digit('md5(k::VARCHAR)', 1)} / 4.0::DOUBLE AS relatedness_score,
         {_sql_digit('md5(k::VARCHAR)', 2)} % 2 AS entailment_judgment,
         CASE WHEN md5(k::VARCHAR) < '2' THEN 'test' ELSE 'train' END AS split
  FROM (
    SELECT a.conv_id * 1000 + a.turn AS k, a.text AS premise, b.text AS hypothesis
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
    WHERE a.role = 'user'
  )
)
"""


def class_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Two scores per labelled document; about one in eight points the wrong way."""
    rows = table(spark, folder, "labels")
    hashed = _hash(F.col("doc_id").cast("string"))
    guess = F.when(_digit(hashed, 1) < 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    sure = 1 + _digit(hashed, 2) / F.lit(16.0)
    return rows.select(
        F.col("doc_id").alias("id"),
        F.array(F.when(guess == 0, sure).otherwise(0.0), F.when(guess == 1, sure).otherwise(0.0)).alias("logits"),
        F.col("quality").alias("label"),
    )


CLASS_PREDICTIONS = f"""
guesses AS (
  SELECT doc_id AS id, quality AS label, 1 + {_sql_digit('md5(doc_id::VARCHAR)', 2)} / 16.0::DOUBLE AS sure,
         CASE WHEN {_sql_digit('md5(doc_id::VARCHAR)', 1)} < 2 THEN 1 - quality ELSE quality END AS guess
  FROM labels
),
predictions AS (
  SELECT id, label, [CASE WHEN guess = 0 THEN sure ELSE 0.0 END, CASE WHEN guess = 1 THEN sure ELSE 0.0 END] AS logits
  FROM guesses
)
"""


def score_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The pair score with a small offset; the test group predicts a constant."""
    rows = pairs(spark, folder)
    hashed = _hash(F.lit("p:"), F.col("sentence_pair_id").cast("string"))
    near = F.col("relatedness_score") + (_digit(hashed, 1) - 8) / F.lit(16.0)
    return rows.select(
        F.col("sentence_pair_id").alias("id"),
        "split",
        F.when(F.col("split") == "test", F.lit(2.5)).otherwise(near).alias("prediction"),
        F.col("relatedness_score").alias("label"),
    )


SCORE_PREDICTIONS = f"""
{PAIRS},
predictions AS (
  SELECT sentence_pair_id AS id, split, relatedness_score AS label,
         CASE WHEN split = 'test' THEN 2.5::DOUBLE ELSE relatedness_score
              + ({_sql_digit("md5('p:' || sentence_pair_id)", 1)} - 8) / 16.0::DOUBLE END AS prediction
  FROM pairs
)
"""


def tag_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Five scores per word, the largest on the tag or, for some words, on the next tag; ignored labels."""
    rows = tagged_words(spark, folder)

    drawn = rows.select(F.col("id").alias("sent_id"), _tag_scores("id", "ner_tags").alias("_drawn"))
    return drawn.select("sent_id", "_drawn.logits", "_drawn.labels")


TAG_TOKENS = f"""
{TAGGED},
tag_rows AS (
  SELECT id AS sent_id, unnest(ner_tags) AS tag, unnest(range(len(ner_tags))) AS pos FROM tagged
),
tag_drawn AS (SELECT *, md5('t:' || sent_id || ':' || pos) AS h FROM tag_rows),
tag_tokens AS (
  SELECT sent_id, pos, tag,
         CASE WHEN {_sql_digit('h', 1)} < 2 THEN (tag + 1) % 5 ELSE tag END AS guess,
         1 + {_sql_digit('h', 2)} / 16.0::DOUBLE AS top,
         CASE WHEN {_sql_digit('h', 3)} = 0 THEN -100 ELSE tag END AS label
  FROM tag_drawn
)
"""


def mask_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Each line is a mask; its distinct words are the candidates, scored by their count in the line.

    The lines move, once, and not their words: counting them and ranking them then finds each mask in one place.
    """
    lines = split_paragraphs(table(spark, folder, "documents").select("doc_id", "text"))
    masks = lines.select(F.col("doc_id").alias("sent_id"), F.col("para_idx").alias("mask_pos"), "text")
    words = masks.repartition("sent_id", "mask_pos").select(
        "sent_id", "mask_pos", F.explode(split_words(F.lower("text"))).alias("piece")
    )
    counted = words.groupBy("sent_id", "mask_pos", "piece").agg(F.count("*").alias("n"))
    return counted.select("sent_id", "mask_pos", "piece", (F.col("n") / 8.0).alias("score"))


MASK_CANDIDATES = f"""
{q.LINES},
candidates AS (
  SELECT doc_id AS sent_id, para_idx AS mask_pos, piece, count(*) / 8.0::DOUBLE AS score
  FROM (SELECT doc_id, para_idx, unnest({q.words('lower(text)')}) AS piece FROM lines)
  GROUP BY ALL
)
"""


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a metric log: user is the run, type the tag, id the step; runs lie under 16 parents."""
    events = table(spark, folder, "events")
    run = F.col("user_id").cast("string")
    return events.select(
        F.substring(_hash(run), 1, 1).alias("parent"),
        run.alias("run_id"),
        F.col("ts").alias("run_ts"),
        F.col("event_type").alias("tag"),
        F.col("event_id").alias("step"),
        "value",
    )


METRIC_LOG = """
metric_log AS (
  SELECT substr(md5(user_id::VARCHAR), 1, 1) AS parent, user_id::VARCHAR AS run_id, ts AS run_ts,
         event_type AS tag, event_id AS step, value FROM events
)
"""


def logging_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The same log with one value per run, tag and hundred steps, so that tags share steps."""
    log = metric_log(spark, folder)
    step = F.floor(F.col("step") / 100).cast("long")
    return log.groupBy("run_id", "tag", step.alias("step")).agg(F.max("value").alias("value"))


LOGGING_STEPS = f"""
{METRIC_LOG},
logging_steps AS (
  SELECT run_id, tag, step // 100 AS step, max(value) AS value FROM metric_log GROUP BY ALL
)
"""


def token_losses(spark: SparkSession, folder: str) -> DataFrame:
    """A loss per word of each document, from the word's hash."""
    docs = table(spark, folder, "documents")
    words = docs.select("lang", F.explode(split_words("text")).alias("word"))
    loss = F.conv(F.substring(_hash(F.col("word")), 1, 4), 16, 10).cast("long") / F.lit(16384.0)
    return words.select("lang", loss.alias("loss"))


TOKEN_LOSSES = f"""
token_losses AS (
  SELECT lang, ('0x' || substr(md5(word), 1, 4))::BIGINT / 16384.0::DOUBLE AS loss
  FROM (SELECT lang, unnest({q.words('text')}) AS word FROM documents)
)
"""
