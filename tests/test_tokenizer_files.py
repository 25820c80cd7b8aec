"""Tokenizer files against the public tokenizers library, where present."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lavra.operators import encoding, unigram, vocabulary
from lavra.sources import tokenizer_files as files
from lavra.sources.corpora import table

lib = pytest.importorskip("tokenizers")
from tokenizers import decoders, models, normalizers as nz, pre_tokenizers as pt, processors  # noqa: E402


def _texts(seed, n):
    rng = random.Random(seed)
    points = [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x2581, 0x660, 0x4E00, 0xAC01, 0x301, 0x308, 0xBD, 0xFB01, 0x1F600, 0x130]
    made = ["".join(chr(rng.choice(points)) for _ in range(rng.randrange(50))) for _ in range(n)]
    words = ["abc", "Don't", "``x''", "12a34", "[MASK]", "[CLS]", "[mask]", " ", "  ", "\n", "ﬁne", "é", "Σας", "x_y", "▁a"]
    return made + ["".join(rng.choices(words, k=rng.randrange(9))) for _ in range(n)] + ["", " ", "[MASK]", "[CLS][SEP] a[MASK]b"]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _same_ids(spark, tok, loaded, texts):
    rows = loaded.encode(_frame(spark, texts))
    rows = rows.select("doc_id", "ids", loaded.framed("ids").alias("framed"), loaded.decode("ids").alias("text")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want, texts[r["doc_id"]]
        assert r["framed"] == tok.encode(texts[r["doc_id"]]).ids
        assert r["text"] == tok.decode(want)


def test_trained_vocabulary_in_the_public_library(spark, tmp_path):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    vocab = unigram.train_unigram(docs, size=1500, seed_size=8000).cache()
    files.save_tokenizer(vocab, str(tmp_path))
    tok = lib.Tokenizer.from_file(str(tmp_path / files.FILE))
    assert tok.get_vocab_size() == 1500
    texts = _texts(1, 200) + [r["text"] for r in docs.limit(50).collect()]
    loaded = files.load_tokenizer(spark, str(tmp_path))
    _same_ids(spark, tok, loaded, texts)
    assert sorted(map(tuple, loaded.vocab.collect())) == sorted(map(tuple, vocab.collect()))
    # The library's own encoder gives them too, where no special token stands in the text.
    plain = [t for t in texts if "[" not in t]
    for r in encoding.encode_documents(_frame(spark, plain), vocab, model="unigram").collect():
        assert r["ids"] == tok.encode(plain[r["doc_id"]], add_special_tokens=False).ids


def test_word_level_file(spark, tmp_path):
    docs = _frame(spark, ["a b b c.", "b 12"])
    files.save_tokenizer(vocabulary.word_vocabulary(docs, size=9), str(tmp_path / "word.json"), model="word")
    tok = lib.Tokenizer.from_file(str(tmp_path / "word.json"))
    _same_ids(spark, tok, files.load_tokenizer(spark, str(tmp_path / "word.json")), _texts(2, 60) + ["a b c d. 12"])


FOREIGN = {
    "white space": (None, pt.Whitespace()),
    "no prefix": (nz.Sequence([nz.NFKC(), nz.Strip(), nz.Replace("a", "bb")]), pt.Sequence([pt.Digits(individual_digits=True), pt.Metaspace(prepend_scheme="never")])),
    "unsplit": (nz.Sequence([nz.NFD(), nz.Prepend("_"), nz.Lowercase()]), pt.Metaspace(prepend_scheme="always", split=False)),
    "none": (nz.NFKD(), None),
}


@pytest.mark.parametrize("name", sorted(FOREIGN))
def test_foreign_files(spark, name):
    letters = sorted({c for t in _texts(3, 150) for c in t})[::2]
    pieces = [("<s>", 0.0), *((c, -5.0 - i / 100) for i, c in enumerate(letters)), ("<unk>", -3.0), ("ab", -2.0), ("bb", -2.5), ("▁a", -1.0), ("12", -2.0)]
    pieces = list(dict(pieces).items())
    tok = lib.Tokenizer(models.Unigram(pieces, unk_id=[p for p, _ in pieces].index("<unk>")))
    if FOREIGN[name][0]:
        tok.normalizer = FOREIGN[name][0]
    if FOREIGN[name][1]:
        tok.pre_tokenizer = FOREIGN[name][1]
    tok.add_special_tokens(["<s>", "[MASK]"])
    tok.post_processor = processors.TemplateProcessing(single="$A <s>", pair="$A <s> $B:1 <s>:1", special_tokens=[("<s>", 0)])
    tok.decoder = decoders.Metaspace(prepend_scheme="never" if name == "no prefix" else "always")
    tok.enable_truncation(40)
    loaded = files.parse_tokenizer(spark, tok.to_str())
    texts = _texts(3, 150)
    rows = loaded.encode(_frame(spark, texts)).collect()
    for r in rows:
        got = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        # Truncation leaves room for the template there, here it is a step of its own.
        assert r["ids"][: len(got)] == got and (len(got) >= 39 or len(r["ids"]) == len(got)), texts[r["doc_id"]]
    pairs = spark.createDataFrame([(i, texts[i], texts[-i - 1]) for i in range(120)], "doc_id long, a string, b string")
    coded = loaded.encode(loaded.encode(pairs, text="a", out="x"), text="b", out="y")
    for r in coded.select("doc_id", loaded.framed("x").alias("f"), loaded.framed_pair("x", "y").alias("p"), loaded.pair_types("x", "y").alias("t")).collect():
        a, b = texts[r["doc_id"]], texts[-r["doc_id"] - 1]
        assert r["f"] == tok.encode(a).ids
        assert (r["p"], r["t"]) == (tok.encode(a, b).ids, tok.encode(a, b).type_ids)


def test_parts_that_are_not_known_raise(spark):
    whole = json.loads(files.tokenizer_text(vocabulary.word_vocabulary(_frame(spark, ["a"]), size=6), model="word"))
    for part, value in (
        ("model", {"type": "BPE"}), ("normalizer", {"type": "Precompiled"}), ("pre_tokenizer", {"type": "ByteLevel"}),
        ("pre_tokenizer", {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first"}), ("decoder", {"type": "WordPiece"}),
        ("post_processor", {"type": "ByteLevel"}), ("pre_tokenizer", {"type": "Punctuation", "behavior": "Removed"}),
        ("normalizer", {"type": "Replace", "pattern": {"Regex": "a"}, "content": ""}),
    ):
        with pytest.raises(files.UnknownPart):
            files.parse_tokenizer(spark, json.dumps({**whole, part: value}))


def test_nulls_and_clashing_columns(spark, tmp_path):
    files.save_tokenizer(vocabulary.word_vocabulary(_frame(spark, ["a b"]), size=7), files.named_by_size(str(tmp_path), 7), model="word")
    loaded = files.load_tokenizer(spark, f"{tmp_path}/7")
    frame = spark.createDataFrame([(1, None, 5, 6), (2, "b a", 7, 8)], "doc_id long, text string, _tokens int, ids int")
    out = loaded.encode(frame)
    assert sorted(map(tuple, out.collect())) == [(1, 5, None), (2, 7, [6, 5])] and out.columns == ["doc_id", "_tokens", "ids"]
    assert loaded.encode(frame.limit(0)).count() == 0
