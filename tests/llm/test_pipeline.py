import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from conftest import SMALL
from lavra.llm import contamination, langid, minhash
from lavra.llm.pii import Pseudonyms
from lavra.llm.queries import QUERY_KEY, learnable


def test_run_against_stage_by_stage_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.run(spark, SMALL).collect()

    model = langid.fit(learnable(docs))
    known = {r.doc_id: r for r in langid.identify(docs, model).where("NOT rejected").collect()}
    assert len(known) > 0.99 * docs.count()
    kept = {i for i, _, _, first in brute.components([(i, r.text) for i, r in known.items()], threshold=80) if first}
    bench = [(b.item_id, contamination.normal(b.text)) for b in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    search = contamination._Search([b for b in bench if len(b[1]) >= contamination.LEAST_CHARS], contamination.SHARE)
    kept = {i for i in kept if not search(known[i].text)}
    change, tokenizer = Pseudonyms(QUERY_KEY), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    got: dict[int, dict] = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        ends = [*r.offsets[1:], len(ids)]
        assert r.offsets[0] == 0 and len(ids) <= 2048
        for i, piece, a, b in zip(r.doc_ids, r.pieces, r.offsets, ends):
            got.setdefault(i, {})[piece] = ids[a:b].tolist()
    assert got.keys() == kept
    for i, parts in got.items():
        want = [*tokenizer.encode(change(known[i].text)[0], add_special_tokens=False).ids, 0]
        assert [x for n in sorted(parts) for x in parts[n]] == want


def test_keep_one_of_repeats_nulls_and_ties(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (3, text), (2, text.upper()), (None, text), (2, text), (7, None), (7, None), (8, ""), (9, "other words here now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS fp", "3 AS n")
    got = sorted(((r.doc_id, r.text) for r in minhash.keep_one(frame).collect()), key=repr)
    first = [g for g in got if g[0] == 2]
    assert len(first) == 1 and first[0][1].lower() == text
    assert [g for g in got if g[0] != 2] == sorted([(7, None), (7, None), (8, ""), (9, "other words here now")], key=repr)
    alone = spark.createDataFrame([(5, text), (5, text)], "doc_id long, text string")
    assert [tuple(r) for r in minhash.keep_one(alone).collect()] == [(5, text)]
    assert minhash.keep_one(frame.limit(0)).count() == 0


def test_keep_one_leaves_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", 4, 5, 6), (2, "one two three four five six", 7, 8, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _hash int, kept_key int, _Kept_hash int")
    out = minhash.keep_one(frame)
    assert out.columns == frame.columns and [tuple(r) for r in out.collect()] == rows[:1]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(60), SMALL).columns == docs.columns, name
