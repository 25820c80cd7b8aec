"""Work and memory that must not grow faster than the input."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from lavra.functions import tokens as tk
from lavra.operators import scores
from lavra.plans import fixtures as fx
from lavra.plans.inputs import table


@F.arrow_udf(T.LongType())
def _batch_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([texts.nbytes] * len(texts))


def test_batches_of_given_tables_are_bounded_in_bytes(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        rows = spark.range(0, 600, numPartitions=1).select("id", F.repeat(F.lit("word "), 40_000).alias("text"))
        rows.write.parquet(f"{tmp_path}/documents.parquet")
        docs = table(spark, str(tmp_path), "documents")
        assert docs.coalesce(1).select(F.max(_batch_bytes("text"))).first()[0] < 20 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_masks_are_counted_and_ranked_after_one_exchange(spark, tmp_path):
    rows = [(1, "b a b\nc"), (1, "a a\nd"), (None, "x"), (2, None), (2, "q w e r t y y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    top = scores.top_candidates(fx.mask_candidates(spark, str(tmp_path)), k=2)
    plan = top._jdf.queryExecution().optimizedPlan().toString() + top._jdf.queryExecution().sparkPlan().toString()
    assert "Repartition" in plan
    executed = top._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1
    got = {(r.sent_id, r.mask_pos, r["rank"]): (r.piece, r.score) for r in top.collect()}
    assert got == {
        (1, 0, 1): ("a", 3 / 8), (1, 0, 2): ("b", 2 / 8), (1, 1, 1): ("c", 1 / 8), (1, 1, 2): ("d", 1 / 8),
        (None, 0, 1): ("x", 1 / 8), (2, 0, 1): ("y", 2 / 8), (2, 0, 2): ("e", 1 / 8),
    }


def test_softmax_of_many_scores_is_linear(spark):
    start = time.monotonic()
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: x / 1000.0).alias("l"))
    assert sum(rows.select(tk.softmax("l").alias("s")).first().s) == pytest.approx(1)
    assert time.monotonic() - start < 30


def test_spans_are_counted_in_the_batch(spark):
    names = ["O", "B-X", "I-X", "B-Y", "I-Y"]

    def logits(tags):
        return [[1.0 if k == t else 0.0 for k in range(5)] for t in tags]

    rows = [([1, 2, 0, 3], logits([1, 2, 0, 3])), ([2], logits([2])), ([], []), (None, logits([1])), ([2, 4, -100, 4], logits([2, 3, 1, 4]))]
    frame = spark.createDataFrame(rows, "labels array<int>, logits array<array<double>>").coalesce(1)
    scored = scores.entity_scores(frame, names)
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()
    got = {r.entity: r for r in scored.collect()}
    assert (got["X"].support, got["X"].recall) == (3, 1.0)
    assert (got["Y"].support, got["Y"].recall, got["overall"].support) == (2, 1.0, 5)
    assert got["overall"].accuracy == pytest.approx(7 / 8)


def test_tags_follow_the_hash_of_place(spark, tmp_path):
    import hashlib

    spark.createDataFrame([(7, "a b c\nd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    drawn = fx.tag_predictions(spark, str(tmp_path))
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "_tag_scores" in plan
    tags = {r.id: r.ner_tags for r in fx.tagged_words(spark, str(tmp_path)).collect()}
    want = {k: [min(int(hashlib.md5(f"{k}:{i}".encode()).hexdigest()[0], 16), 8) % 5 for i in range(n)] for k, n in (("7-0", 3), ("7-1", 1))}
    assert tags == want
    for r in drawn.collect():
        for i, tag in enumerate(want[r.sent_id]):
            h = [int(x, 16) for x in hashlib.md5(f"t:{r.sent_id}:{i}".encode()).hexdigest()[:3]]
            k = (tag + 1) % 5 if h[0] < 2 else tag
            assert r.logits[i] == [1 + h[1] / 16 if j == k else 0.0 for j in range(5)]
            assert r.labels[i] == (-100 if h[2] == 0 else tag)


def test_joined_words_move_once_a_chunk(spark):
    from lavra.operators import encoding

    rows = [(1, ["a"] * 5000 + ["b", None, "z"]), (1, ["a"]), (None, None), (2, [])]
    frame = spark.createDataFrame(rows, "k int, tokens array<string>")
    table = spark.createDataFrame([("a", [7]), ("b", [8, 9])], "word string, ids array<int>")
    flat = encoding.encode_by_join(frame, table)
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "posexplode" not in plan
    assert sorted((r.k or 0, r.ids) for r in flat.collect()) == [(0, []), (1, [7]), (1, [7] * 5000 + [8, 9, 1, 1]), (2, [])]
    nested = encoding.encode_by_join(frame, table, per_token=True)
    assert [r.ids for r in nested.where("size(ids) > 1").collect()] == [[[7]] * 5000 + [[8, 9], [1], [1]]]


def test_plain_words_are_pieces_without_a_search(spark):
    from lavra.functions import text as tx

    words = ["plain", "Upper", "don't", "x1", "", "a\n", "▁a", None]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = frame.select(tx.word_pre_tokens("w").alias("a"), tx.pre_tokens("w").alias("b"))
    assert all(r.a == r.b for r in got.collect())


def test_text_files_share_the_folder_of_their_task(spark, tmp_path, monkeypatch):
    import os

    from lavra.plans import queries_sources

    out = f"{tmp_path}/files"
    monkeypatch.setattr(queries_sources, "new_scratch", lambda *_: out)
    texts = [(i, f"text {i}\nmore") for i in range(300)] + [(300, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    rows = queries_sources.scan_text_files(spark, f"{tmp_path}/in").collect()
    assert sorted((r.doc_id, r.n_chars) for r in rows) == [(i, len(t or "") + 1) for i, t in texts]
    files = [(d, f) for d, _, names in os.walk(out) for f in names if f.endswith(".txt")]
    assert len(files) == 301 and len({d for d, _ in files}) <= 64


def test_best_pieces_hold_little_beyond_the_limit():
    import numpy as np

    from lavra.functions import suffixes

    best, most, rows = suffixes.Best(1000), 0, np.random.default_rng(3).permutation(400_000)
    for part in np.split(rows, 400):
        best.add(pa.array([f"{x:06d}" for x in part]), part)
        most = max(most, best.size)
    assert most <= 101_000 and sorted(best.taken()[1]) == list(range(399_000, 400_000))
    late = best.size
    best.add(pa.array(["000001"] * 1000), np.arange(1000))
    assert best.size == late


def test_plain_sums_give_the_uses_of_logarithms():
    import numpy as np

    from lavra.functions import lattice
    from lavra.operators import unigram

    rng = np.random.default_rng(5)
    scores = np.where(rng.random(500) < 0.5, -np.inf, -1 - 29 * rng.random(500))
    for n in (1, 2, 7, 20, 24):  # the longer ones need a factor a character
        pieces = rng.integers(-1, 500, (len(lattice.edge_ends(n, 16)[0]), 40))
        unknown = unigram._unknown(scores)
        assert lattice.sums_are_plain(n, unknown)
        got = lattice.plain_uses(pieces, n, 16, np.append(np.exp(scores), 0.0), unknown)
        want = lattice.expected_uses(lattice.edge_scores(pieces, n, 16, scores, unknown), n, 16)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert not lattice.sums_are_plain(200, -40.0)


def test_sums_of_pieces_travel_in_rows_of_many(spark, monkeypatch):
    import numpy as np

    from lavra.operators import unigram

    monkeypatch.setattr(unigram, "_SUMS", 2)
    counts = spark.createDataFrame([("abab", 3), ("ba", 2), ("c" * 40, 1)], "word string, count long").repartition(3)
    names = ["a", "ab", "b", "c", "cc", "dead"]
    scores = np.log([0.2, 0.1, 0.3, 0.1, 0.2, 1.0])
    scores[5] = -np.inf
    words = unigram.lattice(counts, names)
    best = unigram._summed(words, scores, unigram._best_uses, 16)
    assert best.tolist() == [2, 6, 2, 0, 20, 0]
    used = unigram._summed(words, scores, unigram._all_uses, 16)
    assert used[0] + used[1] == pytest.approx(3 * 2 + 2) and used[3] + 2 * used[4] == pytest.approx(40) and used[5] == 0
    ab = 0.1 / (0.1 + 0.2 * 0.3)
    assert used[1] == pytest.approx(3 * 2 * ab)


def test_strings_between_spaces_are_counted_before_they_are_searched(spark):
    from lavra.operators import vocabulary

    long = "x,y" * 40
    texts = ["a, a, b  a\u2003b\nC", "a,", None, "", "  ", f"{long} ▁a▁ ▁ a▁b 12ab", "É ''q'' x\u00a0Σ"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = vocabulary.word_counts(frame)
    want = vocabulary.with_tokens(frame).selectExpr("explode(tokens) AS word").groupBy("word").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_chunks_move_packed_and_keep_every_row(spark, monkeypatch):
    from lavra.operators import encoding

    monkeypatch.setattr(encoding, "_CHUNK", 7)
    many = [f"w{i}" for i in range(70_000)]
    rows = [(1, ["a", "b", None, "z"]), (1, ["a"]), (None, None), (2, []), (3, ["b"] * 50), (4, many), (5, None), (5, ["a"] * 7)]
    frame = spark.createDataFrame(rows, "k int, tokens array<string>").coalesce(1)
    ids = [("a", [7]), ("b", [8, 9]), ("w69999", [3]), ("w1", [4])]
    table = spark.createDataFrame(ids, "word string, ids array<int>")
    coded = encoding.encode_by_join(frame, table)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in plan and plan.count("data#") >= 1
    known = dict(ids)
    want = [(k, [i for w in tokens or [] for i in known.get(w, [1])]) for k, tokens in rows]
    assert sorted(((r.k, r.ids) for r in coded.collect()), key=str) == sorted(want, key=str)


def test_chunks_are_cut_by_elements_over_batches(monkeypatch):
    from lavra.operators import encoding

    monkeypatch.setattr(encoding, "_CHUNK", 10)
    sizes = [3, 3, 0, 4, 1, 25, 2, 0, 10, 10, 9, 2, 0]
    lists = [None if n == 0 and i % 2 else [i] * n for i, n in enumerate(sizes)]
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(lists[a:b], pa.list_(pa.int64()))}) for a, b in ((0, 2), (2, 2), (2, 9), (9, 13))]
    chunks = [c.column("x").to_pylist() for c in encoding._cut_chunks(batches, "x")]
    assert sum(chunks, []) == lists
    assert [sum(len(x or []) for x in c) for c in chunks] == [10, 1, 25, 2, 10, 10, 9, 2]


def test_words_and_tags_that_are_not_kept_do_not_move(spark):
    from lavra.operators import tasks, vocabulary

    tagged = spark.createDataFrame([("a", ["New", "it's", "x"], [3, 4, 0], "train")], "id string, tokens array<string>, ner_tags array<int>, split string")
    vocab = vocabulary.numbered([("▁new", 2.0), ("▁it", 1.0), ("▁s", 1.0)], spark)
    rows = tasks.encode_tagged(tagged, vocab, limit=0)
    assert "tokens" not in rows._jdf.queryExecution().optimizedPlan().toString()
    (r,) = rows.collect()
    assert rows.columns == ["id", "split", "input_ids", "attention_mask", "word_ids", "labels"]
    assert (r.id, r.split, r.labels) == ("a", "train", [-100, 3, 4, -100, -100, 0, -100])
    sent = tasks.encode_tagged(tagged, vocab).collect()
    assert sent == rows.collect()
    only = tasks.encode_words(tagged, vocab, limit=0, keep=["id"])
    assert only.columns == ["id", "input_ids", "attention_mask", "word_ids"]
    assert "ner_tags" not in only._jdf.queryExecution().optimizedPlan().toString()


def test_words_stored_in_blocks_give_the_same_sums(spark, monkeypatch):
    import numpy as np

    from lavra.operators import unigram

    monkeypatch.setattr(unigram, "_EDGES", 40)
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 9, 300)} | {"ab" * 30, "", "x" * 20})
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, count long").repartition(2)
    names = ["a", "ab", "abc", "b", "ba", "c", "cc", "x"]
    scores = np.log([0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1])
    rows, blocks = unigram.lattice(counts, names), unigram.lattice(counts, names, blocks=True)
    assert blocks.schema["edges"].dataType.typeName() == "binary" and blocks.count() < rows.count()
    for uses in (unigram._best_uses, unigram._all_uses):
        assert np.allclose(unigram._summed(blocks, scores, uses, 16), unigram._summed(rows, scores, uses, 16))
    table = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word string, count long")
    cost = [unigram.removal_cost(unigram.lattice(table, names, blocks=b), scores, 16) for b in (False, True)]
    assert np.allclose(*cost) and cost[0][1] != 0


def test_known_words_are_kept_between_batches_and_forgotten_when_many(monkeypatch):
    from lavra.operators import encoding

    monkeypatch.setattr(encoding, "_MEMO_WORDS", 4)
    monkeypatch.setattr(encoding, "_SEGMENT_WORDS", 2)
    asked = []

    def ids_of(words):
        asked.append(words.to_pylist())
        return pa.array([[len(w), 7] if w else [] for w in words.to_pylist()], pa.list_(pa.int32()))

    memo = encoding._Memo({"[X]": [5]})
    assert memo.ids(pa.array(["a", "[X]", "bb", "", "ccc"]), ids_of).to_pylist() == [[1, 7], [5], [2, 7], [], [3, 7]]
    assert memo.ids(pa.array([], pa.string()), ids_of).to_pylist() == []
    assert asked == [["a", "bb"], ["", "ccc"]]
    assert memo.ids(pa.array(["ccc", "[X]"]), ids_of).to_pylist() == [[3, 7], [5]] and asked[2:] == [["ccc"]]


def test_spaces_before_pieces_change_nothing(spark):
    from lavra.functions import text as tx

    texts = ["a  b ▁c ,x 1 2", "   ", " \n a", "", " ▁ ▁▁", "x   y", ". . .", "  end  "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all("t", F.lit(tx.PRE_TOKEN_QUICK), F.lit(0))
    assert all(r.a == r.b for r in frame.select(plain.alias("a"), tx.raw_pre_tokens("t").alias("b")).collect())
