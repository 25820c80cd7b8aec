"""The public tokenizers library, where present, as a second opinion. The package itself does not need it."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lavra.functions import tokens as tk
from lavra.operators import encoding, unigram, vocabulary
from lavra.sources import tokenizer_files
from lavra.sources.corpora import table

lib = pytest.importorskip("tokenizers")


def _tokenizer(spark, pieces=()):
    """The public library's reading of a file with these pieces after the special tokens."""
    return lib.Tokenizer.from_str(tokenizer_files.tokenizer_text(vocabulary.numbered(list(pieces), spark)))


def _random_texts(n):
    rng = random.Random(4)
    points = [
        *range(1, 0x250), *range(0x2000, 0x2070), 0x1680, 0x3000, 0x2581, 0x660, 0x4E00, 0x1F600, 0x301, 0x308,
        0xBD, 0x2460, 0x3A3, 0xDF,
    ]
    return ["".join(chr(rng.choice(points)) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pre_tokens(spark):
    texts = _random_texts(2000) + [r["text"] for r in table(spark, SMALL, "documents").collect()]
    tok = _tokenizer(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in vocabulary.with_tokens(df).collect():
        pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(texts[r["doc_id"]]))
        assert r["tokens"] == [p for p, _ in pieces]


def test_same_vocabulary_gives_same_ids_and_text(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    vocab = unigram.train_unigram(docs, size=1500, seed_size=8000)
    tok = _tokenizer(spark, [(r["piece"], r["score"]) for r in vocab.where("NOT is_special").orderBy("id").collect()])
    odd = spark.createDataFrame(list(enumerate(_random_texts(300), 10**6)), "doc_id long, text string")
    texts = docs.unionByName(odd)
    coded = encoding.encode_documents(texts, vocab, model="unigram")
    text = encoding.decode(F.col("ids"), encoding.piece_lookup(vocab))
    got = {r["doc_id"]: r for r in coded.select("doc_id", "ids", text.alias("t")).collect()}
    for r in texts.collect():
        want = tok.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids"] == want
        assert got[r["doc_id"]]["t"] == tok.decode(want, skip_special_tokens=False).replace("[UNK]", "") or tk.UNK in want


@pytest.mark.parametrize("limit", [5, 8, 9])
def test_pair_template_and_truncation(spark, limit):
    tok = _tokenizer(spark, [("▁a", 0.0), ("▁b", 0.0)])
    tok.enable_truncation(limit, strategy="longest_first")
    sizes = [(n, m) for n in range(8) for m in range(8)]
    df = spark.createDataFrame([(n, m, [5] * n, [6] * m) for n, m in sizes], "n int, m int, a array<int>, b array<int>")
    keep_a, keep_b = tk.truncated_pair_sizes("a", "b", limit)
    a, b = F.slice("a", F.lit(1), keep_a), F.slice("b", F.lit(1), keep_b)
    rows = df.select("n", "m", tk.template_pair(a, b).alias("i"), tk.pair_types(a, b).alias("t")).collect()
    for r in rows:
        want = tok.encode(" ".join("a" * r["n"]), " ".join("b" * r["m"]))
        assert (r["i"], r["t"]) == (want.ids, want.type_ids)


def test_single_truncation(spark):
    tok = _tokenizer(spark, [("▁a", 0.0)])
    tok.enable_truncation(6)
    tok.enable_padding(length=6, pad_id=tk.PAD)
    df = spark.createDataFrame([(n, [5] * n) for n in range(9)], "doc_id long, ids array<int>")
    for r in encoding.model_rows(df, max_length=6, pad=True).collect():
        want = tok.encode(" ".join("a" * r["doc_id"]))
        assert r["input_ids"] == want.ids and r["attention_mask"] == want.attention_mask
        assert r["special_tokens_mask"] == want.special_tokens_mask and r["token_type_ids"] == want.type_ids
