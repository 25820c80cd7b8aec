"""Language of texts by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2 to 4 bytes inside a word and its two edges, hashed to ``BUCKETS`` rows. The model
is trained by stochastic gradient descent on a bounded sample; embeddings start at zero, so subwords
never seen pull towards no language. Since the softmax is linear, a text's logits are the mean of its
subwords' logits, which are kept per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lavra.llm.words import SLICE_BYTES, raw, slices, split_words

BUCKETS = 1 << 16
SAMPLE_ROWS = 3072  # labelled texts used for training and calibration, over all languages
WIDTH = 16
EPOCHS = 6
SMOOTH = 0.005
REJECT_SHARE = 0.0005  # share of rightly labelled texts that the rejection threshold may cost
# Subwords take some 50 times the bytes of their words, so only those of this many bytes are held at a time.
_WORD_BYTES = 1 << 18
# Of more languages than this, smaller slices of texts are taken, as sums are held by word and language.
_SLICE_LANGUAGES = 8


@dataclass
class Model:
    """``logits[bucket]`` per language, a temperature and the least confidence that is accepted."""

    languages: list[str]
    logits: np.ndarray
    temperature: float
    threshold: float


def _subwords(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every subword of the distinct words."""
    data, bounds = raw(distinct)
    joined = np.insert(data, bounds, 32)
    edge = joined == 32
    word = np.cumsum(edge) - 1
    values = joined.astype(np.uint32)
    buckets, owners = [], []
    h = values.copy()
    inner = np.zeros(len(h), bool)  # an edge strictly inside the run
    for n in range(2, 5):
        h = h[:-1] * np.uint32(0x01000193) + values[n - 1 :]
        inner = inner[:-1] | (edge[n - 2 : -1] if n > 2 else False)
        good = ~inner
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
        mixed ^= mixed >> np.uint32(12)
        # A run that starts with the edge belongs to the word that follows it.
        buckets.append((mixed & np.uint32(BUCKETS - 1))[good])
        owners.append(word[: len(h)][good])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _bags():
    schema = pa.schema([("lang", pa.string()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), _WORD_BYTES):
                words = split_words(batch.column(1).slice(a, b - a), fold=True)
                bucket, owner = _subwords(words.distinct)
                order = np.argsort(owner, kind="stable")
                bucket, starts = bucket[order], np.searchsorted(owner[order], np.arange(len(words.distinct) + 1))
                langs, at, out = batch.column(0).slice(a, b - a), words.bounds, ([], [], [])
                for i in range(b - a):
                    codes, times = np.unique(words.codes[at[i] : at[i + 1]], return_counts=True)
                    if not len(codes):
                        continue
                    sizes = starts[codes + 1] - starts[codes]
                    all_of = np.concatenate([bucket[starts[c] : starts[c + 1]] for c in codes])
                    total = np.bincount(all_of, weights=np.repeat(times, sizes), minlength=1)
                    known = np.flatnonzero(total)
                    out[0].append(langs[i].as_py())
                    out[1].append(known.astype("<i4").tobytes())
                    out[2].append(total[known].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _train(bags, labels: np.ndarray, n_labels: int, seed: int):
    rng = np.random.default_rng(seed)
    embed = np.zeros((BUCKETS, WIDTH), np.float32)
    weight = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, n_labels)).astype(np.float32)
    steps, step = EPOCHS * max(1, len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = 1 - step / steps
            step += 1
            idx, share = bags[i]
            rows = embed[idx]
            hidden = share @ rows
            z = hidden @ weight
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weight @ p
            weight -= np.float32(0.05 * rate) * np.outer(hidden, p)
            embed[idx] = rows - np.float32(20 * rate) * share[:, None] * back
    return embed @ weight


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, *, key="doc_id", text="text", lang="lang", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Model | None:
    """Train on at most ``sample_rows`` rows, as many per language, chosen by a hash of the key.

    A fifth of them is kept apart: its mean log-loss sets the temperature, and its confidences set the
    threshold under which a prediction is rejected. Rows without language or word are not used; None if
    nothing is left.
    """
    keyed = labelled.where(F.col(lang).isNotNull()).select(F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), lang)
    counts = dict(keyed.groupBy(lang).count().collect())
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col(lang) == name, F.lit(min(1.0, each / n))) for name, n in sorted(counts.items())])
    chosen = labelled.where(F.col(lang).isNotNull() & (draw < share))
    many = chosen.count()
    if many > 2 * sample_rows:  # keys repeat: choose among the rows instead
        chosen = chosen.where(F.rand(seed) < sample_rows / many)
    rows = chosen.select(lang, F.col(text).cast("string").alias("_text"))
    table = rows.mapInArrow(_bags(), "lang string, buckets binary, counts binary").toArrow()
    data = sorted(zip(*(table[c].to_pylist() for c in table.column_names)))
    data = [data[i] for i in np.random.default_rng(seed).permutation(len(data))[:sample_rows]]
    languages = sorted({d[0] for d in data})
    if not languages:
        return None
    bags = []
    for _, buckets, times in data:
        times = np.frombuffer(times, "<f4")
        bags.append((np.frombuffer(buckets, "<i4"), times / times.sum()))
    labels = np.array([languages.index(d[0]) for d in data])
    apart = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.ones(len(bags), bool)
    learn = ~apart if len(bags) >= 50 else apart
    logits = _train([b for b, x in zip(bags, learn) if x], labels[learn], len(languages), seed)
    z = np.array([share @ logits[idx] for (idx, share), x in zip(bags, apart) if x])
    truth = labels[apart]
    scales = np.geomspace(0.02, 5, 60)
    # Smoothed targets keep a sample without errors from asking for certainty.
    target = np.full((len(truth), len(languages)), SMOOTH / len(languages))
    target[np.arange(len(truth)), truth] += 1 - SMOOTH
    losses = [-(target * np.log(_softmax(z / t) + 1e-12)).sum(axis=1).mean() for t in scales]
    temperature = float(scales[int(np.argmin(losses))])
    p = _softmax(z / temperature)
    right = p.argmax(axis=1) == truth
    # The quantile of a small sample is above the one meant, so it is capped halfway to chance.
    low = float(np.quantile(p.max(axis=1)[right], REJECT_SHARE)) if right.any() else 0.0
    chance = 1 / len(languages)
    return Model(languages, logits.astype(np.float32), temperature, min(low, chance + (1 - chance) * 0.25))


def _word_sums(distinct: pa.Array, logits: np.ndarray) -> np.ndarray:
    """Per language, the sum of the logits of every word's subwords; the last row counts these."""
    k = logits.shape[1]
    sums = np.empty((k + 1, len(distinct)))
    for a, b in slices(distinct, _WORD_BYTES):
        bucket, owner = _subwords(distinct.slice(a, b - a))
        for j in range(k):
            sums[j, a:b] = np.bincount(owner, weights=logits[bucket, j], minlength=b - a)
        sums[k, a:b] = np.bincount(owner, minlength=b - a)
    return sums


def _apply(shared):
    @F.arrow_udf("struct<lang_pred: string, score: double, accepted: boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        model = shared.value
        names, k = np.array(model.languages, object), len(model.languages)
        out = ([], [], [])
        for a, b in slices(texts, SLICE_BYTES * _SLICE_LANGUAGES // max(_SLICE_LANGUAGES, k)):
            words = split_words(texts.slice(a, b - a), fold=True)
            sums = _word_sums(words.distinct, model.logits)
            totals = np.empty((b - a, k + 1))
            for j, per_word in enumerate(sums):
                run = np.concatenate(([0.0], np.cumsum(per_word[words.codes])))
                totals[:, j] = run[words.bounds[1:]] - run[words.bounds[:-1]]
            p = _softmax(totals[:, :k] / np.maximum(totals[:, k:], 1) / model.temperature)
            best = p.argmax(axis=1)
            score = p[np.arange(b - a), best]
            out[0].append(names[best])
            out[1].append(score)
            out[2].append(score >= model.threshold)
        flat = [np.concatenate(c) if c else [] for c in out]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds)], ["lang_pred", "score", "accepted"])

    return guess


def identify(docs: DataFrame, model: Model | None, *, text="text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    Texts that are null or hold no letter are ``und`` with score 0 and rejected; so is every text if
    there is no model. Other predictions name a learned language and are rejected below the model's
    threshold. Columns of these names in ``docs`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    if model is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select(*kept, _apply(shared)(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_found"))
    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    return found.select(
        *kept,
        F.when(letters, F.col("_found.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(letters, F.col("_found.score")).otherwise(0.0).alias("score"),
        (~(letters & F.col("_found.accepted"))).alias("rejected"),
    )
