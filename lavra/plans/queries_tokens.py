"""Vocabulary, encoding and task rows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions import text as tx, tokens as tk
from lavra.functions.tokens import VOCABULARY_SIZE
from lavra.operators import cuts, encoding, filters, tasks, unigram, vocabulary
from lavra.plans import fixtures as fx, sql as q
from lavra.plans.inputs import table
from lavra.plans.registry import ORACLES, query
from lavra.session import as_text, fence, new_scratch, stage
from lavra.sources import storage, tokenizer_files

_LENGTH = 512


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def _vocab(spark, folder):
    return vocabulary.word_vocabulary(_docs(spark, folder))


def _encoded(spark, folder):
    return encoding.encode_documents(_docs(spark, folder), _vocab(spark, folder))


@query("pre_tokenize", q.with_(q.PRE) + f"SELECT doc_id, {q.joined('toks')} AS tokens FROM pre")
def pre_tokenize(spark, folder):
    return vocabulary.with_tokens(_docs(spark, folder)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("pre_token_count", q.with_(q.PRE) + "SELECT doc_id, len(toks)::BIGINT AS n_tokens FROM pre")
def pre_token_count(spark, folder):
    normal = fence(_docs(spark, folder), vocabulary.normalize("text").alias("_t"), keep=["doc_id"])
    return normal.select("doc_id", tx.count_pre_tokens("_t").alias("n_tokens"))


@query(
    "word_counts",
    q.with_(q.PRE) + 'SELECT word, count(*) AS "count" FROM (SELECT unnest(toks) AS word FROM pre) GROUP BY word',
)
def word_counts(spark, folder):
    return vocabulary.word_counts(_docs(spark, folder))


@query("word_vocabulary", q.with_(q.PRE, q.vocab()) + "SELECT id, piece, n::DOUBLE AS score FROM vocab")
def word_vocabulary(spark, folder):
    return _vocab(spark, folder).where(~F.col("is_special")).select("id", "piece", "score")


_SEEDS = unigram.SEED_SIZE


@query(
    "unigram_seed_pieces",
    q.with_(
        q.PRE,
        "word_counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(toks) AS word FROM pre) GROUP BY word)",
        "starts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS s FROM word_counts)",
        "spans AS (SELECT word, n, s, unnest(range(2, least(16, length(word) - s + 1) + 1)) AS k FROM starts)",
        "found AS (SELECT substr(word, s, k) AS piece, sum(n) * max(k) AS weight FROM spans GROUP BY 1)",
    )
    + f"SELECT piece, weight::BIGINT AS weight FROM found ORDER BY weight DESC, piece LIMIT {_SEEDS}",
)
def unigram_seed_pieces(spark, folder):
    seeds = unigram.seed_pieces(vocabulary.word_counts(_docs(spark, folder)), size=_SEEDS)
    return seeds.select("piece", "weight")


def _unigram(spark, folder):
    return unigram.train_unigram(_docs(spark, folder))


@query("unigram_vocab")
def unigram_vocab(spark, folder):
    return _unigram(spark, folder).select("id", "piece", F.round("score", 4).alias("score"), "is_special")


@query(
    "unigram_vocab_facts",
    q.with_(q.PRE, "chars AS (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM (SELECT unnest(toks) AS w FROM pre))")
    + "SELECT 0::BIGINT AS beyond_size, 0::BIGINT AS repeated, 0 AS first_id, 0::BIGINT AS gaps, 5::BIGINT AS specials, "
    "(SELECT count(*) FROM chars)::BIGINT AS chars_covered",
)
def unigram_vocab_facts(spark, folder):
    """What holds for every trained vocabulary: its size at most, distinct pieces, gapless ids, and every character covered."""
    vocab = stage(_unigram(spark, folder), "vocabulary")
    words = vocabulary.word_counts(_docs(spark, folder))
    chars = words.select(F.explode(F.split("word", "")).alias("piece")).where("piece <> ''").distinct()
    covered = chars.join(vocab.where(~F.col("is_special")), "piece", "left_semi").agg(F.count("*").alias("chars_covered"))
    n = F.count("*")
    facts = vocab.agg(
        F.greatest(n - VOCABULARY_SIZE, F.lit(0).cast("long")).alias("beyond_size"),
        (n - F.count_distinct("piece")).alias("repeated"),
        F.min("id").alias("first_id"),
        (F.max("id").cast("long") + 1 - n).alias("gaps"),
        F.count_if("is_special").alias("specials"),
    )
    return facts.withColumn("_one", F.lit(1)).join(covered.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("encode_unigram")
def encode_unigram(spark, folder):
    coded = encoding.encode_documents(_docs(spark, folder), _unigram(spark, folder), model="unigram")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), as_text("ids").alias("ids"))


@query(
    "encode_unigram_roundtrip",
    q.with_(q.PRE)
    + "SELECT doc_id, md5(substr(replace(array_to_string(toks, ''), '▁', ' '), 2)) AS text_md5 FROM pre",
)
def encode_unigram_roundtrip(spark, folder):
    """Decoding what was encoded gives the pre-tokens back, whatever vocabulary was trained."""
    vocab = _unigram(spark, folder)
    coded = encoding.encode_documents(_docs(spark, folder), vocab, model="unigram")
    decoded = encoding.decode(F.col("ids"), encoding.piece_lookup(vocab))
    return coded.select("doc_id", F.md5(decoded.cast("binary")).alias("text_md5"))


@query(
    "encode_wordlevel",
    q.with_(q.ENC) + f"SELECT doc_id, len(ids)::BIGINT AS n_ids, {q.joined('ids')} AS ids FROM enc",
)
def encode_wordlevel(spark, folder):
    return _encoded(spark, folder).select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), as_text("ids").alias("ids")
    )


@query(
    "encode_wordlevel_join",
    q.with_(q.ENC) + f"SELECT doc_id, len(ids)::BIGINT AS n_ids, {q.joined('ids')} AS ids FROM enc",
)
def encode_wordlevel_join(spark, folder):
    """The same ids by the way taken when the vocabulary is too large to send out."""
    tokens = vocabulary.with_tokens(_docs(spark, folder))
    coded = encoding.encode_tokens(tokens, _vocab(spark, folder), limit=0)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), as_text("ids").alias("ids"))


@query("template_single", q.with_(q.ENC) + f"SELECT doc_id, {q.joined('[2] || ids || [3]')} AS input_ids FROM enc")
def template_single(spark, folder):
    return _encoded(spark, folder).select("doc_id", as_text(tk.template_single("ids")).alias("input_ids"))


@query(
    "truncate_single",
    q.with_(q.ENC) + f"SELECT doc_id, {q.joined(f'ids[1:{_LENGTH - 2}]')} AS ids FROM enc",
)
def truncate_single(spark, folder):
    return _encoded(spark, folder).select("doc_id", as_text(tk.truncate("ids", _LENGTH)).alias("ids"))


@query(
    "pad_max_length",
    q.with_(q.ENC)
    + f"SELECT doc_id, {q.joined(f'list_resize([2] || ids[1:{_LENGTH - 2}] || [3], {_LENGTH}, 0)')} AS input_ids FROM enc",
)
def pad_max_length(spark, folder):
    rows = encoding.model_rows(_encoded(spark, folder), max_length=_LENGTH, pad=True)
    return rows.select("doc_id", as_text("input_ids").alias("input_ids"))


@query(
    "encode_nopad",
    q.with_(q.ENC)
    + f"SELECT doc_id, (least(len(ids), {_LENGTH - 2}) + 2)::BIGINT AS length, "
    f"{q.joined(f'[2] || ids[1:{_LENGTH - 2}] || [3]')} AS input_ids FROM enc",
)
def encode_nopad(spark, folder):
    rows = encoding.model_rows(_encoded(spark, folder), max_length=_LENGTH)
    return rows.select(
        "doc_id", F.size("input_ids").cast("long").alias("length"), as_text("input_ids").alias("input_ids")
    )


@query(
    "token_masks",
    q.with_(q.ENC, f"sized AS (SELECT doc_id, least(len(ids), {_LENGTH - 2}) AS n FROM enc)")
    + f"SELECT doc_id, repeat('1 ', n + 2) || repeat('0 ', {_LENGTH} - n - 2) AS attention_mask, "
    f"'1 ' || repeat('0 ', n) || repeat('1 ', {_LENGTH} - n - 1) AS special_tokens_mask, "
    f"repeat('0 ', {_LENGTH}) AS token_type_ids FROM sized",
)
def token_masks(spark, folder):
    rows = encoding.model_rows(_encoded(spark, folder), max_length=_LENGTH, pad=True)
    names = ("attention_mask", "special_tokens_mask", "token_type_ids")
    return rows.select("doc_id", *[F.concat(as_text(n), F.lit(" ")).alias(n) for n in names])


_SPLIT_NAMES = """
split_names AS (
  SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id)) <= ceil(0.1::DOUBLE * count(*) OVER ())
                 THEN 'test' ELSE 'train' END AS split FROM documents
)
"""


@query(
    "tokenize_corpus",
    q.with_(q.ENC, _SPLIT_NAMES)
    + f"SELECT doc_id, split, {q.joined('[2] || ids[1:8190] || [3]')} AS input_ids, "
    "(least(len(ids), 8190) + 2)::BIGINT AS length FROM enc JOIN split_names USING (doc_id)",
)
def tokenize_corpus(spark, folder):
    """Split, encode, frame, store by split, read back."""
    docs = cuts.train_test_split(_docs(spark, folder))
    coded = encoding.encode_documents(docs, _vocab(spark, folder))
    rows = storage.save(encoding.model_rows(coded), new_scratch(spark, "tokenized"))
    return rows.select(
        "doc_id", "split", as_text("input_ids").alias("input_ids"),
        F.size("attention_mask").cast("long").alias("length"),
    )


@query(
    "filter_tokenized",
    q.with_(q.ENC, f"padded AS (SELECT doc_id, list_resize([2] || ids[1:{_LENGTH - 2}] || [3], {_LENGTH}, 0) AS ids FROM enc)")
    + f"SELECT doc_id, md5({q.joined('ids')}) AS ids_md5 FROM padded WHERE ids[-1] = 0 AND ids[11] <> 0",
)
def filter_tokenized(spark, folder):
    rows = encoding.model_rows(_encoded(spark, folder), max_length=_LENGTH, pad=True)
    kept = filters.drop_bad_token_rows(fence(rows, F.col("input_ids").alias("ids"), keep=["doc_id"]), "ids")
    return kept.select("doc_id", F.md5(as_text("ids").cast("binary")).alias("ids_md5"))


@query(
    "ids_to_pieces",
    q.with_(
        q.ENC,
        "pieces AS (SELECT doc_id, pos, coalesce(piece, '[UNK]') AS piece FROM enc_tok LEFT JOIN vocab ON tok = piece)",
    )
    + "SELECT doc_id, coalesce(p.pieces, '') AS pieces FROM documents LEFT JOIN "
    "(SELECT doc_id, string_agg(piece, ' ' ORDER BY pos) AS pieces FROM pieces GROUP BY doc_id) AS p USING (doc_id)",
)
def ids_to_pieces(spark, folder):
    vocab = _vocab(spark, folder)
    coded = encoding.encode_documents(_docs(spark, folder), vocab)
    pieces = encoding.piece_lookup(vocab)(F.col("ids"))
    return coded.select("doc_id", F.array_join(pieces, " ").alias("pieces"))


@query(
    "decode_ids",
    q.with_(q.ENC, "known AS (SELECT doc_id, pos, piece FROM enc_tok JOIN vocab ON tok = piece)")
    + "SELECT doc_id, md5(coalesce(k.whole, '')) AS text_md5 FROM documents LEFT JOIN "
    "(SELECT doc_id, substr(replace(string_agg(piece, '' ORDER BY pos), '▁', ' '), 2) AS whole "
    "FROM known GROUP BY doc_id) AS k USING (doc_id)",
)
def decode_ids(spark, folder):
    vocab = _vocab(spark, folder)
    coded = encoding.encode_documents(_docs(spark, folder), vocab)
    framed = coded.select("doc_id", tk.template_single("ids").alias("ids"))
    text = encoding.decode(F.col("ids"), encoding.piece_lookup(vocab))
    return framed.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


@query("vocab_roundtrip", q.with_(q.PRE, q.vocab()) + """
SELECT id, piece, false AS is_special FROM vocab UNION ALL
SELECT * FROM (VALUES (0, '[PAD]', true), (1, '[UNK]', true), (2, '[CLS]', true), (3, '[SEP]', true), (4, '[MASK]', true))
""")
def vocab_roundtrip(spark, folder):
    stored = vocabulary.save_vocabulary(_vocab(spark, folder), new_scratch(spark, "vocab"))
    return stored.select("id", "piece", "is_special")


def _tokenizer_file(spark, folder):
    """The word-level vocabulary written as a tokenizer file and read again."""
    path = new_scratch(spark, "tokenizer")
    tokenizer_files.save_tokenizer(_vocab(spark, folder), path, model="word", max_length=_LENGTH)
    return tokenizer_files.load_tokenizer(spark, path)


@query(
    "tokenizer_file_vocab",
    q.with_(q.PRE, q.vocab())
    + "SELECT id, piece, false AS is_special FROM vocab UNION ALL SELECT * FROM (VALUES (0, '[PAD]', true), "
    "(1, '[UNK]', true), (2, '[CLS]', true), (3, '[SEP]', true), (4, '[MASK]', true))",
)
def tokenizer_file_vocab(spark, folder):
    return _tokenizer_file(spark, folder).vocab.select("id", "piece", "is_special")


@query(
    "tokenizer_file_encode",
    q.with_(q.ENC) + f"SELECT doc_id, len(ids)::BIGINT AS n_ids, {q.joined('ids')} AS ids FROM enc",
)
def tokenizer_file_encode(spark, folder):
    """The ids of all texts by the parts of a tokenizer file."""
    coded = _tokenizer_file(spark, folder).encode(_docs(spark, folder))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), as_text("ids").alias("ids"))


_TAGGED_ENC = q.with_(
    q.PRE,
    q.vocab(),
    fx.TAGGED,
    "tagged_words AS (SELECT id, unnest(tokens) AS w, unnest(ner_tags) AS tag, unnest(range(len(tokens))) AS wi FROM tagged)",
    f"word_toks AS (SELECT id, wi, tag, {q.pre('w')} AS toks FROM tagged_words)",
    "flat AS (SELECT id, wi, tag, unnest(toks) AS tok, unnest(range(len(toks))) AS k FROM word_toks)",
    f"""coded AS (
  SELECT id, list(coalesce(v.id, 1) ORDER BY wi, k)[1:{_LENGTH - 2}] AS ids, list(wi ORDER BY wi, k)[1:{_LENGTH - 2}] AS words,
         list(CASE WHEN k = 0 THEN tag ELSE -100 END ORDER BY wi, k)[1:{_LENGTH - 2}] AS labels
  FROM flat LEFT JOIN (SELECT id, piece FROM vocab) v(vid, piece) ON tok = piece GROUP BY id
)""".replace("v.id", "vid"),
)


@query(
    "encode_words",
    _TAGGED_ENC
    + f"SELECT id, {q.joined('[2] || ids || [3]')} AS input_ids, '- ' || {q.joined('words')} || ' -' AS word_ids FROM coded",
)
def encode_words(spark, folder):
    rows = tasks.encode_words(fx.tagged_words(spark, folder), _vocab(spark, folder), max_length=_LENGTH)
    words = F.transform("word_ids", lambda w: F.coalesce(w.cast("string"), F.lit("-")))
    return rows.select("id", as_text("input_ids").alias("input_ids"), F.array_join(words, " ").alias("word_ids"))


@query(
    "align_labels",
    _TAGGED_ENC
    + f"SELECT id, {q.joined('[-100] || labels || [-100]')} AS labels, len(labels)::BIGINT + 2 AS length FROM coded",
)
def align_labels(spark, folder):
    rows = tasks.encode_tagged(fx.tagged_words(spark, folder), _vocab(spark, folder), max_length=_LENGTH)
    return rows.select("id", as_text("labels").alias("labels"), F.size("input_ids").cast("long").alias("length"))


@query("encode_words_join", ORACLES["encode_words"])
def encode_words_join(spark, folder):
    tagged, vocab = fx.tagged_words(spark, folder), _vocab(spark, folder)
    rows = tasks.encode_words(tagged, vocab, max_length=_LENGTH, limit=0, keep=["id"])
    words = F.transform("word_ids", lambda w: F.coalesce(w.cast("string"), F.lit("-")))
    return rows.select("id", as_text("input_ids").alias("input_ids"), F.array_join(words, " ").alias("word_ids"))


@query("align_labels_join", ORACLES["align_labels"])
def align_labels_join(spark, folder):
    tagged, vocab = fx.tagged_words(spark, folder), _vocab(spark, folder)
    rows = tasks.encode_tagged(tagged, vocab, max_length=_LENGTH, limit=0)
    return rows.select("id", as_text("labels").alias("labels"), F.size("input_ids").cast("long").alias("length"))


@query("decode_ids_join", ORACLES["decode_ids"])
def decode_ids_join(spark, folder):
    vocab = _vocab(spark, folder)
    coded = encoding.encode_documents(_docs(spark, folder), vocab)
    framed = coded.select("doc_id", tk.template_single("ids").alias("ids"))
    text = encoding.decoded(framed, vocab, limit=0)
    return text.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_PAIR_LENGTH = 128
_PAIR_ENC = q.with_(
    q.PRE,
    q.vocab(),
    fx.PAIRS,
    f"pa AS (SELECT sentence_pair_id AS k, {q.pre('premise')} AS toks FROM pairs)",
    f"pb AS (SELECT sentence_pair_id AS k, {q.pre('hypothesis')} AS toks FROM pairs)",
    q.encoded("pa", "k", "toks", "ea"),
    q.encoded("pb", "k", "toks", "eb"),
    f"""sides AS (
  SELECT ea.k, ea.ids AS a, eb.ids AS b, len(ea.ids) AS n, len(eb.ids) AS m, {_PAIR_LENGTH - 3} AS budget
  FROM ea JOIN eb USING (k)
)""",
    """cut AS (
  SELECT k, CASE WHEN n + m <= budget THEN a WHEN n <= m THEN a[1:least(n, budget // 2)]
                 ELSE a[1:budget - least(m, budget // 2)] END AS a,
            CASE WHEN n + m <= budget THEN b WHEN n <= m THEN b[1:budget - least(n, budget // 2)]
                 ELSE b[1:least(m, budget // 2)] END AS b
  FROM sides
)""",
)


def _coded_pairs(spark, folder, **options):
    pairs, vocab = fx.pairs(spark, folder), _vocab(spark, folder)
    return tasks.encode_pairs(pairs, vocab, label="entailment_judgment", **options)


@query(
    "template_pair",
    _PAIR_ENC
    + f"SELECT k AS sentence_pair_id, {q.joined('[2] || a || [3] || b || [3]')} AS input_ids, "
    "repeat('0 ', len(a) + 2) || repeat('1 ', len(b) + 1) AS token_type_ids FROM (SELECT ea.k, ea.ids AS a, eb.ids AS b "
    "FROM ea JOIN eb USING (k))",
)
def template_pair(spark, folder):
    rows = _coded_pairs(spark, folder)
    types = F.concat(as_text("token_type_ids"), F.lit(" "))
    return rows.select("sentence_pair_id", as_text("input_ids").alias("input_ids"), types.alias("token_type_ids"))


@query(
    "truncate_pair",
    _PAIR_ENC + f"SELECT k AS sentence_pair_id, {q.joined('[2] || a || [3] || b || [3]')} AS input_ids FROM cut",
)
def truncate_pair(spark, folder):
    rows = _coded_pairs(spark, folder, max_length=_PAIR_LENGTH)
    return rows.select("sentence_pair_id", as_text("input_ids").alias("input_ids"))


@query(
    "encode_pairs",
    _PAIR_ENC
    + f"""SELECT k AS sentence_pair_id,
  {q.joined(f'list_resize([2] || a || [3] || b || [3], {_PAIR_LENGTH}, 0)')} AS input_ids,
  repeat('0 ', len(a) + 2) || repeat('1 ', len(b) + 1) || repeat('0 ', {_PAIR_LENGTH} - len(a) - len(b) - 3) AS token_type_ids,
  repeat('1 ', len(a) + len(b) + 3) || repeat('0 ', {_PAIR_LENGTH} - len(a) - len(b) - 3) AS attention_mask,
  relatedness_score AS labels
FROM cut JOIN pairs ON k = sentence_pair_id""",
)
def encode_pairs(spark, folder):
    pairs, vocab = fx.pairs(spark, folder), _vocab(spark, folder)
    rows = tasks.encode_pairs(pairs, vocab, label="relatedness_score", max_length=_PAIR_LENGTH, pad=True)
    return rows.select(
        "sentence_pair_id",
        as_text("input_ids").alias("input_ids"),
        *[F.concat(as_text(c), F.lit(" ")).alias(c) for c in ("token_type_ids", "attention_mask")],
        "labels",
    )


@query(
    "mlm_mask",
    q.with_(
        q.ENC,
        "framed AS (SELECT doc_id, [2] || ids[1:8190] || [3] AS ids FROM enc)",
        "positions AS (SELECT doc_id, unnest(ids) AS x, unnest(range(len(ids))) AS pos, len(ids) AS n FROM framed)",
        "drawn AS (SELECT *, md5('42:0:' || doc_id || ':' || pos) AS h FROM positions)",
        "chosen AS (SELECT *, pos > 0 AND pos < n - 1 AND substr(h, 1, 8) < '4ccccccc' AS hit FROM drawn)",
        """masked AS (
  SELECT doc_id, pos, CASE WHEN NOT hit THEN x WHEN substr(h, 9, 8) < 'cccccccc' THEN 4
    WHEN substr(h, 9, 8) < 'e6666666' THEN ('0x' || substr(h, 17, 8))::BIGINT % 32768 ELSE x END AS y,
    CASE WHEN hit THEN x ELSE -100 END AS label FROM chosen
)""",
    )
    + "SELECT doc_id, string_agg(y::VARCHAR, ' ' ORDER BY pos) AS input_ids, "
    "string_agg(label::VARCHAR, ' ' ORDER BY pos) AS labels FROM masked GROUP BY doc_id",
)
def mlm_mask(spark, folder):
    rows = encoding.model_rows(_encoded(spark, folder))
    rows = rows.select("doc_id", "input_ids", "special_tokens_mask")
    masked = tasks.mask_tokens(rows, seed=42)
    return masked.select("doc_id", as_text("input_ids").alias("input_ids"), as_text("labels").alias("labels"))


@query(
    "batch_pad",
    q.with_(
        q.ENC,
        "framed AS (SELECT doc_id, [2] || ids[1:8190] || [3] AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM enc)",
        "sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM framed)",
    )
    + f"SELECT batch_id, doc_id, {q.joined('list_resize(ids, longest, 0)')} AS input_ids FROM sized",
)
def batch_pad(spark, folder):
    rows = encoding.model_rows(_encoded(spark, folder)).select("doc_id", "input_ids")
    keys = _docs(spark, folder).select("doc_id")
    return tasks.batch_pad(rows, batch_size=32, keys=keys).select("batch_id", "doc_id", as_text("input_ids").alias("input_ids"))
