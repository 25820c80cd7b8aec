import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lavra.functions import lattice, suffixes, tokens as tk
from lavra.operators import encoding, tasks, unigram, vocabulary
from conftest import SMALL
from lavra.sources.corpora import table


def _one(spark, **columns):
    row = spark.range(1)
    return row.select(*[F.array(*map(F.lit, v)).cast("array<int>").alias(k) for k, v in columns.items()])


@pytest.mark.parametrize("limit", [4, 5, 7, 10])
def test_pair_sizes(spark, limit):
    sizes = [(n, m) for n in range(9) for m in range(9)]
    df = spark.createDataFrame([([1] * n, [1] * m) for n, m in sizes], "a array<int>, b array<int>")
    keep_a, keep_b = tk.truncated_pair_sizes("a", "b", limit)
    budget = limit - 3
    for r in df.select(F.size("a").alias("n"), F.size("b").alias("m"), keep_a.alias("x"), keep_b.alias("y")).collect():
        n, m, x, y = r
        if n + m <= budget:
            assert (x, y) == (n, m)
            continue
        assert x + y == budget and x <= n and y <= m
        if min(n, m) <= budget // 2:
            assert min(x, y) == min(n, m) or (x, y) in ((n, budget - n), (budget - m, m))
        else:
            assert abs(x - y) <= 1


def test_rows_and_masks(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, list(range(5, 25)))], "doc_id long, ids array<int>")
    for r in encoding.model_rows(df, max_length=8, pad=True).collect():
        n = min({1: 3, 2: 0, 3: 20}[r["doc_id"]], 6)
        assert r["attention_mask"] == [1] * (n + 2) + [0] * (8 - n - 2)
        assert r["special_tokens_mask"] == [1] + [0] * n + [1] * (8 - n - 1)
        assert r["input_ids"][0] == 2 and r["input_ids"][n + 1] == 3 and len(r["input_ids"]) == 8
        assert r["token_type_ids"] == [0] * 8
    for r in encoding.model_rows(df, max_length=8).collect():
        assert len({len(r[c]) for c in ("input_ids", "attention_mask", "special_tokens_mask", "token_type_ids")}) == 1


def test_pair_template(spark):
    df = _one(spark, a=[7], b=[8, 9])
    r = df.select(tk.template_pair("a", "b").alias("i"), tk.pair_types("a", "b").alias("t")).first()
    assert r["i"] == [2, 7, 3, 8, 9, 3] and r["t"] == [0, 0, 0, 1, 1, 1]


def test_align(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, 2, 2, None], [3, 4, 0])], "w array<int>, t array<int>")
    assert df.select(tk.align_labels("w", "t")).first()[0] == [-100, 3, -100, 4, 0, -100, -100]


def test_argmax_and_softmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>")
    r = df.select(tk.argmax("l").alias("a"), tk.softmax("l").alias("s")).first()
    assert r["a"] == 1 and sum(r["s"]) == pytest.approx(1) and r["s"][1] == pytest.approx(np.exp(2) / (1 + 2 * np.exp(2)))


def _splits(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_lattice_against_all_segmentations():
    scores = {"a": -1.0, "b": -2.0, "ab": -1.5, "ba": -2.5, "aba": -2.2, "bb": -3.0, "c": -4.0}
    known, values, unknown = pa.array(list(scores)), np.array(list(scores.values())), -9.0
    words = ["a", "abab", "abba", "bcaxb", "abaab", "xx", "aba", "b" * 6]
    numbers = lattice.segment(pa.array(words), known, values, 16, unknown)
    for n, rows, pieces in lattice.edge_pieces(pa.array(words), 16, known):
        edge = lattice.edge_scores(pieces, n, 16, values, unknown)
        uses = lattice.expected_uses(edge, n, 16)
        best, _ = lattice.best_path(edge, n, 16)
        for column, row in enumerate(rows):
            word, options = words[row], []
            for parts in _splits(word):
                if all(p in scores or len(p) == 1 for p in parts):
                    options.append((sum(scores.get(p, unknown) for p in parts), parts))
            top = max(s for s, _ in options)
            assert best[column] == pytest.approx(top)
            mass = sum(np.exp(s) for s, _ in options)
            for at, (s, e) in enumerate(zip(*map(np.ndarray.tolist, lattice.edge_ends(n, 16)))):
                assert (s, e) == list(lattice.edges_of(n, 16))[at]
                want = 0.0
                for score, parts in options:
                    place = 0
                    for p in parts:
                        want += np.exp(score) / mass * ((place, place + len(p)) == (s, e))
                        place += len(p)
                assert uses[at, column] == pytest.approx(want, abs=1e-12)
            got = numbers[row]
            text = "".join(known[p].as_py() if p >= 0 else "?" for p in got)
            assert text == word.replace("x", "?").replace("??", "?")


@pytest.fixture(scope="module")
def trained(spark):
    texts = table(spark, SMALL, "documents").select("doc_id", "text")
    return texts, unigram.train_unigram(texts, size=800, seed_size=4000).cache()


def test_trained_vocabulary(trained):
    texts, vocab = trained
    rows = vocab.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(800))
    assert tuple(r["piece"] for r in rows[:5]) == tk.SPECIAL_TOKENS and all(r["is_special"] for r in rows[:5])
    pieces = {r["piece"] for r in rows[5:]}
    assert len(pieces) == 795
    chars = {c for r in vocabulary.word_counts(texts).select("word").collect() for c in r["word"]}
    assert chars | unigram.byte_alphabet() <= pieces
    scores = [r["score"] for r in rows[5:]]
    assert scores == sorted(scores, reverse=True)
    assert any(len(p) > 3 for p in pieces)


def test_byte_alphabet():
    letters = unigram.byte_alphabet()
    assert len(letters) == 256 and {"Ġ", "Ċ", "a", "ÿ", "Ń"} <= letters and " " not in letters


def test_unigram_round_trip_and_join_path(trained):
    texts, vocab = trained
    tokens = vocabulary.with_tokens(texts)
    by_udf = encoding.encode_tokens(tokens, vocab, model="unigram")
    by_join = encoding.encode_tokens(tokens, vocab, model="unigram", limit=0)
    left = {r["doc_id"]: r["ids"] for r in by_udf.collect()}
    right = {r["doc_id"]: r["ids"] for r in by_join.collect()}
    assert left == right and len(left) == 200
    look_up = encoding.piece_lookup(vocab)
    decoded = by_udf.select("doc_id", encoding.decode(F.col("ids"), look_up).alias("t"))
    joined = tokens.select("doc_id", F.array_join("tokens", "").alias("j"))
    for r in decoded.join(joined, "doc_id").collect():
        assert r["t"] == r["j"].replace("▁", " ").removeprefix(" ")


def test_unknown_characters_fuse(spark, docs):
    vocab = vocabulary.numbered([("▁", -1.0), ("a", -2.0), ("▁a", -1.5)], spark)
    coded = encoding.encode_documents(docs("a xyz a", "日本", "").select("doc_id", "text"), vocab, model="unigram")
    assert [r["ids"] for r in coded.orderBy("doc_id").collect()] == [[7, 5, 1, 7], [5, 1], []]


def test_wordlevel_paths_agree_with_empty_documents(spark, docs):
    texts = docs("the cat", "", "a dog", "  ").select("doc_id", "text")
    vocab = vocabulary.word_vocabulary(docs("the cat the").select("doc_id", "text"), size=7)
    tokens = vocabulary.with_tokens(texts)
    a = encoding.encode_tokens(tokens, vocab).orderBy("doc_id").collect()
    b = encoding.encode_tokens(tokens, vocab, limit=0).orderBy("doc_id").collect()
    assert [r["ids"] for r in a] == [r["ids"] for r in b] == [[5, 6], [], [1, 1], []]


@pytest.mark.parametrize("model", ["word", "unigram"])
def test_encode_words(spark, trained, model):
    _, vocab = trained
    if model == "word":
        vocab = vocabulary.numbered([("▁the", 2), ("▁cat", 1), ("▁,", 1)], spark)
    tagged = spark.createDataFrame(
        [("s1", ["The", "cat,", ""], [1, 2, 3]), ("s2", [], []), ("s3", ["x"] * 40, [4] * 40)],
        "id string, tokens array<string>, ner_tags array<int>",
    )
    rows = {r["id"]: r for r in tasks.encode_words(tagged, vocab, max_length=12, pad=True, model=model).collect()}
    labels = {r["id"]: r["labels"] for r in tasks.encode_tagged(tagged, vocab, max_length=12, pad=True, model=model).collect()}
    for key, r in rows.items():
        assert len(r["input_ids"]) == len(r["word_ids"]) == len(r["attention_mask"]) == len(labels[key]) == 12
        for i, w in enumerate(r["word_ids"]):
            first = w is not None and (i == 0 or r["word_ids"][i - 1] != w)
            assert labels[key][i] == (r["ner_tags"][w] if first else -100)
    words = [w for w in rows["s1"]["word_ids"] if w is not None]
    assert words == sorted(words) and set(words) == {0, 1}
    if model == "word":
        assert rows["s1"]["input_ids"] == [2, 5, 6, 7, 3] + [0] * 7
        assert rows["s1"]["word_ids"] == [None, 0, 1, 1, None] + [None] * 7


def test_encode_words_with_a_unigram_vocabulary_by_join(spark, trained):
    texts, vocab = trained
    tagged = spark.createDataFrame(
        [("s1", ["The", "cat,", ""], [1, 2, 3]), ("s2", [], []), ("s3", ["x日y"] * 40, [4] * 40), ("s1", ["Zażółć", "日本日", "a"], [1, 2, 3])],
        "id string, tokens array<string>, ner_tags array<int>",
    )
    more = texts.limit(40).selectExpr("cast(doc_id AS string) AS id", "slice(split(text, ' '), 1, 30) AS tokens", "transform(slice(split(text, ' '), 1, 30), x -> 1) AS ner_tags")
    tagged = tagged.unionByName(more)
    for fn in (tasks.encode_words, tasks.encode_tagged):
        sent = fn(tagged, vocab, max_length=64, pad=True, model="unigram")
        joined = fn(tagged, vocab, max_length=64, pad=True, model="unigram", limit=0)
        assert joined.columns == sent.columns
        assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, sent.collect()), key=repr)


def test_masking(spark):
    n = 4000
    df = spark.createDataFrame(
        [(d, [2] + [9] * n + [3], [1] + [0] * n + [1]) for d in range(5)],
        "doc_id long, input_ids array<int>, special_tokens_mask array<int>",
    )
    first = tasks.mask_tokens(df, seed=1).orderBy("doc_id").collect()
    kinds = {"mask": 0, "random": 0, "same": 0}
    for r in first:
        assert r["labels"][0] == r["labels"][-1] == -100 and r["input_ids"][0] == 2 and r["input_ids"][-1] == 3
        for x, label in zip(r["input_ids"], r["labels"]):
            if label == -100:
                assert x in (2, 3, 9)
            else:
                assert label == 9
                kinds["mask" if x == 4 else "same" if x == 9 else "random"] += 1
    total = sum(kinds.values())
    assert total / (5 * n) == pytest.approx(0.3, abs=0.02)
    assert kinds["mask"] / total == pytest.approx(0.8, abs=0.03) and kinds["same"] / total == pytest.approx(0.1, abs=0.02)
    assert tasks.mask_tokens(df.repartition(3), seed=1).orderBy("doc_id").collect() == first
    assert tasks.mask_tokens(df, seed=1, epoch=1).orderBy("doc_id").collect() != first


def test_batches(spark):
    df = spark.createDataFrame(
        [(k, [1] * (k % 5 + 1), [7] * (k % 5 + 1)) for k in range(23)], "doc_id long, input_ids array<int>, labels array<int>"
    )
    out = tasks.batch_pad(df, batch_size=4, pads={"input_ids": 0, "labels": -100}).collect()
    assert len(out) == 23
    for r in out:
        assert r["batch_id"] == r["doc_id"] // 4
        mates = [k % 5 + 1 for k in range(23) if k // 4 == r["batch_id"]]
        own = r["doc_id"] % 5 + 1
        assert r["input_ids"] == [1] * own + [0] * (max(mates) - own)
        assert r["labels"] == [7] * own + [-100] * (max(mates) - own)


@pytest.mark.parametrize("kind", ["long", "string", "binary", "timestamp", "double"])
def test_batches_move_rows_once(spark, monkeypatch, kind):
    """Batches of any key, whole stretches of several batches as well, with a null key and columns that clash."""
    i = F.col("id")
    key = {
        "long": i * 1000 - 7,
        "string": F.when(i > 0, F.concat(F.lit("ké"), F.lpad(i.cast("string"), 4, "0"))).otherwise("\U0001F600"),
        "binary": F.lpad(i.cast("string"), 4, "0").cast("binary"),
        "timestamp": F.timestamp_micros(i * 3_600_000_000),
        "double": F.when(i == 5, float("nan")).otherwise(i / 3),
    }[kind]
    rows = spark.range(203).select(F.when(i != 9, key).alias("k"), F.array_repeat(F.lit(1), (i % 11 + 1).cast("int")).alias("input_ids"), F.lit(0).alias("_stretch"))
    order = [r["input_ids"] for r in rows.orderBy("k").collect()]
    want = sorted((at // 8, len(ids), max(map(len, order[at // 8 * 8 : at // 8 * 8 + 8]))) for at, ids in enumerate(order))
    for most in (1 << 16, 3):
        monkeypatch.setattr(tasks, "STRETCHES", most)
        out = tasks.batch_pad(rows, batch_size=8, key="k")
        assert out.columns == ["batch_id", "k", "_stretch", "input_ids"]
        assert sorted((r["batch_id"], sum(r["input_ids"]), len(r["input_ids"])) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1, plan


def _substrings(words, longest):
    found = {}
    for w, n in words:
        for s in range(len(w)):
            for e in range(s + 2, min(len(w), s + longest) + 1):
                found[w[s:e]] = found.get(w[s:e], 0) + n
    return sorted((p, n, n * len(p)) for p, n in found.items())


@pytest.mark.parametrize("block, parts", [(1 << 16, 1), (7, 9)])
def test_substring_totals_against_brute_force(spark, monkeypatch, block, parts):
    rng = random.Random(block)
    words = {"".join(rng.choices("abé日", k=rng.randrange(9))) for _ in range(300)} | {"abcab" * 30, "a", "", "a\0b\0", "ab\0", "cabbage" * 2}
    rows = [(w, rng.randrange(1, 9)) for w in sorted(words)]
    monkeypatch.setattr(suffixes, "BLOCK", block)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        counts = spark.createDataFrame(rows, "word string, count long").repartition(3)
        assert sorted(map(tuple, unigram.candidate_pieces(counts, longest=4).collect())) == _substrings(rows, 4)
        best = sorted(_substrings(rows, 16), key=lambda r: (-r[2], r[0]))[:40]
        assert [tuple(r) for r in unigram.seed_pieces(counts, size=40).orderBy(F.desc("weight"), "piece").collect()] == best
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_best_of_many_batches_keeps_ties():
    best = suffixes.Best(3)
    for start in range(0, 300_000, 1000):
        best.add(pa.array([f"{start + i:06d}" for i in range(1000)]), np.arange(start, start + 1000) // 2)
    assert best.taken()[1].tolist() == [149_998, 149_998, 149_999, 149_999][-4:]


def test_word_of_ten_million_characters(spark):
    counts = spark.range(1).selectExpr("repeat('abcdefghij', 1000000) AS word", "2L AS count")
    seeds = unigram.seed_pieces(counts, size=20).orderBy(F.desc("weight"), "piece").collect()
    assert seeds[0]["piece"] == "abcdefghijabcdef" and seeds[0]["uses"] == 2 * 999_999
    cut = unigram._in_parts(counts)
    assert tuple(cut.agg(F.max(F.length("word")), F.sum(F.length("word"))).first()) == (unigram.TRAINED_CHARS, 10_000_000)
    stored = unigram.lattice(cut.limit(2_000), ["a", "ab", "cdef"])
    assert stored.agg(F.max(F.size("edges"))).first()[0] < 16 * unigram.TRAINED_CHARS + 1


def test_long_words_in_the_lattice(monkeypatch):
    known, values = pa.array(["a", "b", "ab", "ba"]), np.array([-1.0, -2.0, -1.5, -2.6])
    words = pa.array(["ab" * 40 + "x", "b" * 81, "a", "abba", "ba" * 30])
    want = lattice.segment(words, known, values, 16, -9.0)
    monkeypatch.setattr(lattice, "_LONG_WORD", 2)
    monkeypatch.setattr(lattice, "_BLOCK", 100)
    assert lattice.segment(words, known, values, 16, -9.0) == want
    assert want[0] == [2] * 40 + [-1] and want[1] == [1] * 81


def test_join_encoding_keeps_rows_of_one_key_apart(spark):
    from lavra.operators import encoding, vocabulary

    texts = spark.createDataFrame([(1, "a b c"), (1, "d e"), (None, "a"), (2, "")], "doc_id long, text string")
    vocab = vocabulary.word_vocabulary(texts)
    tokens = vocabulary.with_tokens(texts)
    assert sorted(encoding.encode_tokens(tokens, vocab, limit=0).collect(), key=repr) == sorted(encoding.encode_tokens(tokens, vocab).collect(), key=repr)
