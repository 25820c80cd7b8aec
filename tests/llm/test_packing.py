import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from lavra.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def _whole(rows, size):
    """Every sequence is gapless from 0 and at most ``size`` long."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_whole_table_against_plain_encoding(spark):
    rows = queries.op1(spark, SMALL).collect()
    tokenizer, want = Tokenizer.from_file(PATH), []
    for i, t in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SMALL}/documents.parquet'").fetchall():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((i, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = _whole(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 2


def test_words_give_the_ids_of_the_text():
    rng = random.Random(1)
    parts = ["a", "B", "e.", "A,", "».", "é", "é", " ", "\n", "\t", "\x0b", " ", "'s", "'", "9", "!", "<|endoftext|>", "日", "ß", "İ", "Σ", "👍"]
    encode, plain = packing._Encoder(PATH), Tokenizer.from_file(PATH)
    import pyarrow as pa

    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids, text


class _Counting:
    """A tokenizer that counts the texts it gets and their words."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts, self.words = tokenizer, 0, Counter()

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        self.words.update(w for t in texts for w in t.split())
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_go_to_the_tokenizer_many_at_a_time_and_once_for_all_spellings():
    encode = packing._Encoder(PATH, True)
    counting = encode.tokenizer = _Counting(encode.tokenizer)
    words = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("st", "nd", "rm", "lt", "ng", "x", "qu", "zz")]
    text = " ".join([*words, *(w.title() + "!" for w in words), *(w.upper() + "$$$" for w in words)])
    ids, bounds = encode(pa.array([text, None, text]))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and bounds.tolist() == [0, len(want), len(want), 2 * len(want)]
    assert counting.texts <= len(words) // packing._JOINED + 2
    assert counting.words["bast"] == 1 and not {"Bast!", "Bast", "BAST$$$", "BAST"} & set(counting.words)


def test_odd_words_marks_and_capitals_among_joined_words():
    rng = random.Random(8)
    parts = ["a", "Te", "H\u0331", "J\u030c", "\x7f", "|", "+", "=\u0338", "<|endoftext|>", "<|ENDOFTEXT|>", "\u2167", "\u0130", "K", "'S", "'ll", "$", "#", "-", "_", "\u00c9", "7", " ", "\n"]
    plain = Tokenizer.from_file(PATH)
    for marked in (True, False):
        texts = ["".join(rng.choices(parts, k=rng.randrange(400))) for _ in range(40)]
        encode = packing._Encoder(PATH, True)
        assert encode.folds and encode.mark
        encode.mark = encode.mark if marked else None
        ids, bounds = encode(pa.array(texts))
        for n, text in enumerate(texts):
            assert ids[bounds[n] : bounds[n + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_in_use_stay_known_when_the_memo_is_full(monkeypatch):
    monkeypatch.setattr(packing, "_MEMO_WORDS", 200)
    encode, plain = packing._Encoder(PATH, True), Tokenizer.from_file(PATH)
    counting = encode.tokenizer = _Counting(encode.tokenizer)
    letters = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    for n in range(12):
        text = " ".join(["known", "words", *(f"{w}{letters[n]}" for w in letters[:150])])
        assert encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert counting.words["known"] == counting.words["words"] == 1
    assert len(encode.known) == len(encode.sizes) == len(encode.uses) <= 200 + 152
    monkeypatch.setattr(packing, "_MEMO_IDS", 4_000)
    for n in range(3):
        encode(pa.array(["known " + "xyz" * 3_000 + letters[n]]))
    assert len(encode.store) <= 4_000 + 9_002 and counting.words["known"] == 1


def _one_at_a_time(counts, size):
    """Best-two-fit on single pieces."""
    left, bins = Counter(counts), []
    while +left:
        used, room = [], size
        for length in sorted(left, reverse=True):
            while left[length] and length <= room:
                left[length] -= 1
                room -= length
                used.append(length)
        if room and len(used) > 1:
            small = used[-1]
            pairs = [(a + b, a, b) for a in +left for b in +left if a >= b and small < a + b <= room + small and (a != b or left[a] > 1)]
            if pairs:
                _, a, b = max(pairs)
                left[small] += 1
                left[a] -= 1
                left[b] -= 1
                used[-1:] = [a, b]
        bins.append(tuple(sorted(used)))
    return sorted(bins)


def test_plan_is_best_two_fit():
    rng = random.Random(2)
    for _ in range(120):
        size = rng.choice([7, 20, 60])
        counts = {rng.randrange(1, size + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))}
        rows, patterns = packing.plan(counts, size), {}
        for length, first, copies, sequence, offset in rows.tolist():
            patterns.setdefault(sequence, []).append((length, copies))
        starts = sorted(patterns)
        placed = Counter()
        bins = []
        total = max(s + (c - f) for s, c, f in [(0, 0, 0)])
        for n, s in enumerate(starts):
            # A pattern repeats until the next one begins; the last as often as its pieces last.
            length, copies = patterns[s][0]
            times = (starts[n + 1] - s) if n + 1 < len(starts) else (counts[length] - placed[length]) // copies
            for length, copies in patterns[s]:
                placed[length] += copies * times
            bins += [tuple(sorted(x for length, copies in patterns[s] for x in [length] * copies))] * times
        assert dict(placed) == counts and total == 0
        assert sorted(bins) == _one_at_a_time(counts, size)


def test_sequences_nulls_ties_and_clashing_names(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefg", k=rng.randrange(90)))) for i in range(200)]
    rows += [(7, "a b c"), (7, "a b c"), (None, "x"), (900, None), (901, ""), (902, "z" * 50_000), (903, "q " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit(1), "ids": F.lit(2), "_part": F.lit(3)})
    pieces = packing.token_pieces(frame, PATH, size=64)
    packed = packing.pack(pieces, size=64)
    out = packed.collect()
    assert len(out) == pieces.count() and _whole(out, 64) == packed.select("sequence_id").distinct().count()
    assert sorted(r.length for r in out if r.doc_id in (900, 901)) == [1, 1]
    joined = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in out:
        ids = np.frombuffer(joined[r.sequence_id].ids, "<u4")[r.offset : r.offset + r.length]
        assert ids.tobytes() == bytes(r.ids)
    assert packing.pack(packing.token_pieces(frame.limit(0), PATH)).count() == 0


def test_tokenizers_that_join_over_spaces_get_whole_texts(spark):
    assert packing._Encoder(PATH).by_words
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing._Encoder(path).by_words
    rng = random.Random(6)
    parts = ["the ", " end", "\n\n", "don't", "x1 ", "  ", "é", "日本", "...", "7", "👍"]
    texts = {i: "".join(rng.choices(parts, k=rng.randrange(20))) for i in range(200)} | {500: None, 501: ""}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.token_pieces(frame, path, size=16, end=50256).collect()
    got = {i: b"".join(r.ids for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == i) for i in texts}
    plain = Tokenizer.from_file(path)
    for i, t in texts.items():
        assert list(np.frombuffer(got[i], "<u4")) == [*plain.encode(t or "", add_special_tokens=False).ids, 50256]
