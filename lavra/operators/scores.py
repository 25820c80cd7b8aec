"""Scores of predictions against labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lavra.functions.tokens import IGNORE, argmax, softmax
from lavra.session import fence


def label_table(spark, names: list[str]) -> DataFrame:
    """Class ids and their names."""
    return spark.createDataFrame(list(enumerate(names)), "id int, name string")


def with_label_names(rows: DataFrame, labels: DataFrame, *, label="label", out="label_name"):
    """Add the name of a class id. Spark sends the label table out while it is small enough."""
    named = rows.join(labels, rows[label] == labels["id"], "left")
    return named.select(*rows.columns, F.col("name").alias(out))


def tags_from_logits(rows: DataFrame, names: list[str], *, logits="logits") -> DataFrame:
    """Most likely tag of each token with its probability, from one array of scores per token."""
    table = F.array(*map(F.lit, names))
    others = [c for c in rows.columns if c != logits]
    exploded = rows.select(*others, F.posexplode(logits).alias("pos", "_scores"))
    shares = fence(exploded, softmax("_scores").alias("_p"), keep=[*others, "pos"])
    return shares.select(
        *others,
        "pos",
        F.get(table, argmax("_p")).alias("tag"),
        F.array_max("_p").alias("probability"),
    )


def _spans(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Entity spans of the tags of many rows in order, as first and last places.

    A code is twice the type for ``B``, one more for ``I``, negative for ``O``. A span opens at ``B``, or at
    ``I`` after ``O`` or after another type, and runs to the next opening or ``O``, at most to the end of its
    row; ``first`` and ``last`` mark the ends of rows. Spans do not overlap, so the n-th opening meets the n-th
    end.
    """
    apart = (codes[1:] % 2 == 0) | (codes[:-1] < 0) | (codes[1:] < 0) | (codes[:-1] >> 1 != codes[1:] >> 1)
    opens, ends = first.copy(), last.copy()
    opens[1:] |= apart
    ends[:-1] |= apart
    return np.flatnonzero(opens & (codes >= 0)), np.flatnonzero(ends & (codes >= 0))


def _span_counts(batches):
    """Spans of each type by labels, by predictions and by both, and right tokens of all, in a batch of sentences."""
    for batch in batches:
        sides = [batch.column(name) for name in ("_true", "_pred")]
        sizes = sides[0].value_lengths().to_numpy(zero_copy_only=False)
        sizes = sizes[sizes > 0]
        true, pred = (side.flatten().to_numpy(zero_copy_only=False) for side in sides)
        first, last = np.zeros(len(true), bool), np.zeros(len(true), bool)
        stops = np.cumsum(sizes)
        first[stops - sizes] = True
        last[stops - 1] = True
        (a, b), (c, d) = _spans(true, first, last), _spans(pred, first, last)
        _, here, there = np.intersect1d(a, c, assume_unique=True, return_indices=True)
        same = a[here][(b[here] == d[there]) & (true[a[here]] >> 1 == pred[c[there]] >> 1)]
        codes, counts = [-4, -3], [sum(batch.column(n).to_pylist()) for n in ("_right", "_tokens")]
        for number, (side, found) in enumerate(((true, a), (pred, c), (true, same))):
            uses = np.bincount(side[found] >> 1)
            kinds = np.flatnonzero(uses)
            codes += (kinds * 4 + number).tolist()
            counts += uses[kinds].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])


def entity_scores(rows: DataFrame, names: list[str], *, logits="logits", labels="labels") -> DataFrame:
    """Precision, recall and F1 over exact entity spans, per type and over all, with token accuracy.

    ``rows`` has one sentence per row: an array of scores per token, and the labels; positions with the
    ignored label do not count; a label without a name counts as outside. Spans are matched inside the row,
    a batch of rows at once; only counts by type leave a batch. Names without a type give the line over all alone.
    """
    entity_types = sorted({n.split("-", 1)[1] for n in names if n[:2] in ("B-", "I-")})
    numbers = {name: at for at, name in enumerate(entity_types)}
    codes = F.array(
        *[F.lit(2 * numbers[n.split("-", 1)[1]] + (n[0] == "I") if n[:2] in ("B-", "I-") else -1) for n in names]
    )
    both = F.zip_with(
        labels, logits, lambda label, scores: F.struct(label.alias("t"), argmax(scores).alias("p"))
    )
    counted = fence(
        rows.select(labels, logits), F.filter(both, lambda x: x["t"] != IGNORE).alias("_both"), keep=[]
    )
    tags = fence(
        counted,
        F.transform("_both", lambda x: F.coalesce(F.get(codes, x["t"]), F.lit(-1))).alias("_true"),
        F.transform("_both", lambda x: F.coalesce(F.get(codes, x["p"]), F.lit(-1))).alias("_pred"),
        F.size(F.filter("_both", lambda x: x["t"] == x["p"])).alias("_right"),
        F.size("_both").alias("_tokens"),
        keep=[],
    )
    parts = tags.where(F.col("_true").isNotNull()).mapInArrow(_span_counts, "code long, n long")
    summed = parts.groupBy("code").agg(F.sum("n").alias("n"))

    def total(number, below=False):
        wanted = (F.col("code") < 0) if below else (F.col("code") >= 0)
        return F.sum(F.when(wanted & (F.pmod("code", F.lit(4)) == number), F.col("n")).otherwise(0))

    each = F.explode(F.array(F.lit(-2).cast("long"), F.shiftright("code", 2))).alias("type")
    sums = [total(0).alias("true"), total(1).alias("pred"), total(2).alias("hits")]
    sums += [total(0, True).alias("right"), total(1, True).alias("tokens")]
    total = summed.select("code", "n", each).where("type <> -1").groupBy("type").agg(*sums)
    lines = [(-2, "overall"), *enumerate(entity_types)]
    table = rows.sparkSession.createDataFrame(lines, "type long, entity string")
    found = table.join(total, "type", "left")
    zero = F.lit(0.0)
    return found.select(
        "entity",
        F.coalesce(F.try_divide("hits", "pred"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "true"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hits"), F.col("true") + F.col("pred")), zero).alias("f1"),
        F.coalesce("true", F.lit(0)).cast("long").alias("support"),
        F.when(F.col("type") == -2, F.try_divide("right", "tokens")).alias("accuracy"),
    )


def classification_scores(rows: DataFrame, *, logits="logits", label="label") -> DataFrame:
    """Accuracy, and F1 averaged over the classes seen in labels or predictions."""
    pairs = rows.select(F.col(label).cast("int").alias("t"), argmax(logits).alias("p"))
    confusion = pairs.groupBy("t", "p").agg(F.count("*").alias("n"))
    right, zero = F.col("t") == F.col("p"), F.lit(0).cast("long")
    hit, miss = F.when(right, F.col("n")).otherwise(zero), F.when(~right, F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("t").alias("c"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn")),
        F.struct(F.col("p").alias("c"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn")),
    )
    per_class = confusion.select(F.inline(sides)).groupBy("c").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    f1 = F.coalesce(
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)
    )
    return per_class.agg(
        F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
    )


def regression_scores(rows: DataFrame, *, prediction="prediction", label="label", by=()) -> DataFrame:
    """Mean squared error and Pearson correlation; no correlation when a side is constant."""
    scores = rows.groupBy(*by).agg(
        F.avg(F.pow(F.col(prediction) - F.col(label), F.lit(2))).alias("mse"),
        F.covar_pop(prediction, label).alias("_c"),
        (F.stddev_pop(prediction) * F.stddev_pop(label)).alias("_s"),
    )
    return scores.select(*by, "mse", F.try_divide("_c", "_s").alias("pearson"))


def perplexity(losses: DataFrame, *, loss="loss", by=()) -> DataFrame:
    """Exponential of the mean loss."""
    return losses.groupBy(*by).agg(F.exp(F.avg(loss)).alias("perplexity"))


def best_step(log: DataFrame, *, tag: str, greater_is_better: bool = True, by=("run_id",)) -> DataFrame:
    """Step with the best value of a metric in each run; the earliest on a tie."""
    value = F.col("value") if greater_is_better else -F.col("value")
    best = F.max(F.struct(value.alias("v"), (-F.col("step")).alias("s")))
    found = log.where(F.col("tag") == tag).groupBy(*by).agg(best.alias("_b"))
    shown = F.col("_b.v") if greater_is_better else -F.col("_b.v")
    return found.select(*by, (-F.col("_b.s")).alias("step"), shown.alias("value"))


def top_candidates(candidates: DataFrame, *, k: int = 5) -> DataFrame:
    """The ``k`` best pieces of each mask. Candidates dealt by mask already don't move; of others, Spark keeps
    only k rows per mask and task before the shuffle."""
    order = Window.partitionBy("sent_id", "mask_pos").orderBy(F.desc("score"), "piece")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
