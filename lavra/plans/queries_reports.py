"""Reports, scores and metric series over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions import tokens as tk
from lavra.operators import encoding, reports, scores, series, vocabulary
from lavra.plans import fixtures as fx, sql as q
from lavra.plans.evaluation import evaluate
from lavra.plans.inputs import table
from lavra.plans.registry import query


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def _vocab(spark, folder):
    return vocabulary.word_vocabulary(_docs(spark, folder))


def _rounded(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in df.columns])


def _per_document(spark, folder):
    return reports.fertility_per_document(_docs(spark, folder), _vocab(spark, folder))


_FERTILITY = q.with_(
    q.ENC,
    """per_doc AS (
  SELECT doc_id, len(ids)::BIGINT AS n_subwords, len(toks)::BIGINT AS n_words,
         coalesce(len(ids)::DOUBLE / nullif(len(toks), 0), 0.0) AS fertility FROM enc JOIN pre USING (doc_id)
)""",
)


@query("fertility_per_doc", _FERTILITY + "SELECT * FROM per_doc")
def fertility_per_doc(spark, folder):
    return _per_document(spark, folder)


@query(
    "fertility_macro",
    _FERTILITY + "SELECT avg(fertility) AS avg_fertility, max(fertility) AS max_fertility FROM per_doc",
)
def fertility_macro(spark, folder):
    return reports.fertility_macro(_per_document(spark, folder))


@query(
    "fertility_micro",
    _FERTILITY
    + "SELECT sum(n_subwords + 2)::BIGINT AS generated, sum(n_words)::BIGINT AS original, "
    "round(sum(n_subwords + 2)::DOUBLE / sum(n_words), 6) AS fertility FROM per_doc",
)
def fertility_micro(spark, folder):
    return _rounded(reports.fertility_micro(_per_document(spark, folder)), fertility=6)


@query("fertility_unigram")
def fertility_unigram(spark, folder):
    from lavra.operators.unigram import train_unigram

    docs = _docs(spark, folder)
    vocab = train_unigram(docs)
    return _rounded(reports.fertility_per_document(docs, vocab, model="unigram"), fertility=6)


@query(
    "token_distribution",
    q.with_(
        q.PRE,
        """sizes AS (
  SELECT len(toks) + 2 AS n FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM pre) WHERE rn % 100 = 0
)""",
    )
    + "SELECT count(*) AS documents, sum(n)::BIGINT AS tokens, count(*) FILTER (n > 1000) AS over_threshold, "
    "max(n)::BIGINT AS max_length, round(avg(n), 6) AS avg_length, round(sum(n) / 1e9, 9) AS tokens_billions, "
    "round(100.0::DOUBLE * count(*) FILTER (n > 1000) / count(*), 6) AS percent_over FROM sizes",
)
def token_distribution(spark, folder):
    report = reports.token_distribution(_docs(spark, folder), _vocab(spark, folder))
    return _rounded(report, avg_length=6, tokens_billions=9, percent_over=6)


@query(
    "seq_length_report",
    q.with_(q.PRE, "lengths AS (SELECT least(len(toks), 8190) + 2 AS n FROM pre)")
    + """SELECT count(*) AS sequences, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS mean_length,
  min(n)::BIGINT AS min_length, max(n)::BIGINT AS max_length,
  floor(quantile_cont(n, 0.25))::BIGINT AS p25, quantile_cont(n, 0.5)::DOUBLE AS median_length,
  floor(quantile_cont(n, 0.75))::BIGINT AS p75, floor(quantile_cont(n, 0.9))::BIGINT AS p90,
  floor(quantile_cont(n, 0.99))::BIGINT AS p99, count(*) FILTER (n = 8192) AS at_limit,
  count(*) FILTER (n > 8192) AS over_limit, count(*) FILTER (n < 20) AS too_short, count(*) FILTER (n > 1024) AS good,
  round(count(*) FILTER (n = 8192)::DOUBLE / count(*), 6) AS at_limit_share,
  round(count(*) FILTER (n > 8192)::DOUBLE / count(*), 6) AS over_limit_share,
  round(count(*) FILTER (n < 20)::DOUBLE / count(*), 6) AS too_short_share,
  round(count(*) FILTER (n > 1024)::DOUBLE / count(*), 6) AS good_share FROM lengths""",
)
def seq_length_report(spark, folder):
    coded = encoding.encode_documents(_docs(spark, folder), _vocab(spark, folder))
    report = reports.sequence_length_report(encoding.model_rows(coded))
    shares = {f"{c}_share": 6 for c in ("at_limit", "over_limit", "too_short", "good")}
    return _rounded(report, mean_length=6, **shares)


@query(
    "logits_argmax",
    q.with_(fx.CLASS_PREDICTIONS)
    + "SELECT id, label, (list_position(logits, list_max(logits)) - 1)::INT AS predicted FROM predictions",
)
def logits_argmax(spark, folder):
    rows = fx.class_predictions(spark, folder)
    return rows.select("id", "label", tk.argmax("logits").alias("predicted"))


@query(
    "tag_from_logits",
    q.with_(fx.TAG_TOKENS)
    + f"SELECT sent_id, pos::INT AS pos, {q.text_list(fx.TAGS)}[guess + 1] AS tag, "
    "round(exp(top) / (exp(top) + 4), 6) AS probability FROM tag_tokens",
)
def tag_from_logits(spark, folder):
    rows = fx.tag_predictions(spark, folder).select("sent_id", "logits")
    return _rounded(scores.tags_from_logits(rows, fx.TAGS), probability=6)


# Spans as islands of a running count, the other way round from the jobs: one row per token.
_SPANS = q.with_(
    fx.TAG_TOKENS,
    f"""named AS (
  SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY pos) AS pos, label, guess,
         {q.text_list(fx.TAGS)}[label + 1] AS t, {q.text_list(fx.TAGS)}[guess + 1] AS p
  FROM tag_tokens WHERE label <> -100
)""",
    """long AS (
  SELECT 't' AS side, sent_id, pos, t AS tag FROM named UNION ALL SELECT 'p', sent_id, pos, p FROM named
)""",
    """marks AS (
  SELECT *, tag[1] AS bio, substr(tag, 3) AS kind,
         lag(tag[1]) OVER w AS last_bio, lag(substr(tag, 3)) OVER w AS last_kind
  FROM long WINDOW w AS (PARTITION BY side, sent_id ORDER BY pos)
)""",
    """opened AS (
  SELECT *, CASE WHEN bio = 'B' OR (bio = 'I' AND (last_bio IS NULL OR last_bio = 'O' OR last_kind <> kind))
            THEN 1 ELSE 0 END AS opens FROM marks
)""",
    """islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY side, sent_id ORDER BY pos) AS island FROM opened WHERE bio <> 'O'
)""",
    "spans AS (SELECT side, sent_id, island, kind, min(pos) AS a, max(pos) AS b FROM islands GROUP BY ALL)",
    "ts AS (SELECT * FROM spans WHERE side = 't')",
    "ps AS (SELECT * FROM spans WHERE side = 'p')",
    "hits AS (SELECT ts.kind FROM ts JOIN ps USING (sent_id, kind, a, b))",
    """counts AS (
  SELECT kind, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (
    SELECT kind, 1 AS t, 0 AS p, 0 AS h FROM ts UNION ALL SELECT kind, 0, 1, 0 FROM ps UNION ALL
    SELECT kind, 0, 0, 1 FROM hits) GROUP BY kind
)""",
)
_RATES = (
    "round(h::DOUBLE / p, 6) AS precision, round(h::DOUBLE / t, 6) AS recall, "
    "round(2.0::DOUBLE * h / (t + p), 6) AS f1, t::BIGINT AS support"
)


def _entities(spark, folder):
    rows = fx.tag_predictions(spark, folder)
    scored = evaluate("ner", rows, names=fx.TAGS)
    return _rounded(scored, precision=6, recall=6, f1=6, accuracy=6)


@query("ner_per_entity", _SPANS + f"SELECT kind AS entity, {_RATES} FROM counts")
def ner_per_entity(spark, folder):
    return _entities(spark, folder).where("entity <> 'overall'").drop("accuracy")


@query(
    "ner_overall",
    _SPANS
    + f"SELECT 'overall' AS entity, {_RATES}, (SELECT round(avg((label = guess)::INT), 6) FROM named) AS accuracy "
    "FROM (SELECT sum(t) AS t, sum(p) AS p, sum(h) AS h FROM counts)",
)
def ner_overall(spark, folder):
    return _entities(spark, folder).where("entity = 'overall'")


@query(
    "classification_scores",
    q.with_(
        fx.CLASS_PREDICTIONS,
        "classes AS (SELECT label AS c FROM guesses UNION SELECT guess FROM guesses)",
        """per_class AS (
  SELECT c, coalesce(2.0::DOUBLE * count(*) FILTER (label = c AND guess = c)
    / nullif(count(*) FILTER (label = c) + count(*) FILTER (guess = c), 0), 0) AS f1
  FROM classes JOIN guesses ON c IN (label, guess) GROUP BY c
)""",
    )
    + "SELECT round((SELECT avg((label = guess)::INT) FROM guesses), 6) AS accuracy, "
    "round((SELECT avg(f1) FROM per_class), 6) AS macro_f1",
)
def classification_scores(spark, folder):
    return _rounded(evaluate("rte", fx.class_predictions(spark, folder)), accuracy=6, macro_f1=6)


@query(
    "regression_scores",
    q.with_(fx.SCORE_PREDICTIONS)
    + "SELECT split, round(avg((prediction - label) ** 2), 6) AS mse, "
    "CASE WHEN stddev_pop(prediction) * stddev_pop(label) > 0 THEN round(corr(prediction, label), 6) END AS pearson "
    "FROM predictions GROUP BY split",
)
def regression_scores(spark, folder):
    rows = fx.score_predictions(spark, folder)
    return _rounded(evaluate("sts", rows, by=["split"]), mse=6, pearson=6)


@query(
    "perplexity",
    q.with_(fx.TOKEN_LOSSES) + "SELECT lang, round(exp(avg(loss)), 6) AS perplexity FROM token_losses GROUP BY lang",
)
def perplexity(spark, folder):
    return _rounded(evaluate("mlm", fx.token_losses(spark, folder), by=["lang"]), perplexity=6)


@query(
    "best_step",
    q.with_(fx.METRIC_LOG)
    + "SELECT run_id, step, value FROM metric_log WHERE tag = 'purchase' "
    "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY value DESC, step) = 1",
)
def best_step(spark, folder):
    return scores.best_step(fx.metric_log(spark, folder), tag="purchase")


@query(
    "best_step_lowest",
    q.with_(fx.METRIC_LOG)
    + "SELECT run_id, step, value FROM metric_log WHERE tag = 'error' "
    "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY value, step) = 1",
)
def best_step_lowest(spark, folder):
    return scores.best_step(fx.metric_log(spark, folder), tag="error", greater_is_better=False)


@query(
    "ema_smooth",
    q.with_(
        fx.METRIC_LOG,
        "listed AS (SELECT run_id, tag, list(step ORDER BY step) AS steps, list(value ORDER BY step) AS xs FROM metric_log GROUP BY ALL)",
        "points AS (SELECT run_id, tag, unnest(steps) AS step, unnest(range(1, len(xs) + 1)) AS i, xs FROM listed)",
    )
    + "SELECT run_id, tag, step, xs[i] AS value, round("
    "list_reduce(list_transform(xs[1:i], lambda x, j: x * 0.6::DOUBLE ** (i - j)), lambda a, b: a + b) "
    "/ list_reduce(list_transform(xs[1:i], lambda x, j: 0.6::DOUBLE ** (i - j)), lambda a, b: a + b), 6) AS smoothed FROM points",
)
def ema_smooth(spark, folder):
    log = fx.metric_log(spark, folder).select("run_id", "tag", "step", "value")
    return _rounded(series.smooth(log, smoothing=0.6, chunk=1024), smoothed=6)


_GAPS = "CASE WHEN step % 5 = 0 THEN NULL ELSE value END"


@query(
    "ema_smooth_gaps",
    q.with_(
        fx.METRIC_LOG,
        f"listed AS (SELECT run_id, tag, list(step ORDER BY step) AS steps, list({_GAPS} ORDER BY step) AS xs FROM metric_log GROUP BY ALL)",
        "points AS (SELECT run_id, tag, unnest(steps) AS step, unnest(range(1, len(xs) + 1)) AS i, xs FROM listed)",
        "sums AS (SELECT run_id, tag, step, xs[i] AS value, "
        "list_sum(list_transform(xs[1:i], lambda x, j: coalesce(x, 0) * 0.99::DOUBLE ** (i - j))) AS total, "
        "list_sum(list_transform(xs[1:i], lambda x, j: CASE WHEN x IS NULL THEN 0 ELSE 0.99::DOUBLE ** (i - j) END)) AS weight FROM points)",
    )
    + "SELECT run_id, tag, step, value, round(total / nullif(weight, 0), 6) AS smoothed FROM sums",
)
def ema_smooth_gaps(spark, folder):
    log = fx.metric_log(spark, folder).select("run_id", "tag", "step", F.expr(_GAPS).alias("value"))
    return _rounded(series.smooth(log, smoothing=0.99, chunk=1024), smoothed=6)


@query(
    "split_log_series",
    q.with_(fx.LOGGING_STEPS)
    + "SELECT run_id, step, max(value) FILTER (tag = 'click') AS click, max(value) FILTER (tag = 'view') AS view, "
    "max(value) FILTER (tag = 'error') AS error FROM logging_steps WHERE tag IN ('click', 'view', 'error') GROUP BY ALL",
)
def split_log_series(spark, folder):
    return series.wide_series(fx.logging_steps(spark, folder), ["click", "view", "error"])


@query(
    "join_series",
    q.with_(fx.LOGGING_STEPS)
    + "SELECT run_id, step, a.value AS click, b.value AS view FROM (FROM logging_steps WHERE tag = 'click') a "
    "FULL JOIN (FROM logging_steps WHERE tag = 'view') b USING (run_id, step)",
)
def join_series(spark, folder):
    return series.overlay(fx.logging_steps(spark, folder), "click", "view")


@query(
    "fill_mask_topk",
    q.with_(fx.MASK_CANDIDATES)
    + "SELECT *, row_number() OVER (PARTITION BY sent_id, mask_pos ORDER BY score DESC, piece)::INT AS rank "
    "FROM candidates QUALIFY rank <= 5",
)
def fill_mask_topk(spark, folder):
    return scores.top_candidates(fx.mask_candidates(spark, folder), k=5)
