import random

from pyspark.sql import functions as F

from conftest import SMALL
from lavra.llm import contamination as c, queries


def _distance(pattern, text):
    """Least edits of the pattern to a substring, by the plain table."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        row = [i + 1]
        for j, b in enumerate(text):
            row.append(min(last[j + 1] + 1, row[-1] + 1, last[j] + (a != b)))
        last = row
    return min(last)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        pattern = "".join(rng.choices("abc ", k=rng.randrange(1, 90)))
        text = list("".join(rng.choices("abc ", k=rng.randrange(120))) + pattern)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = rng.choice("abcd")
        found = c.distance_at(pattern, "".join(text), len(pattern))
        assert (found[0] if found else len(pattern)) == _distance(pattern, "".join(text))


def _edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["x"], [out[at], "y"]])
    return "".join(out)


def test_items_with_edits_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=12)).capitalize() + ".") for i in range(25)] + [(98, "too short"), (99, None)]
    items.append((100, items[0][1]))
    docs = []
    for i in range(150):
        text = " ".join(rng.choices(words, k=40))
        if i % 2:
            text += "\n" + _edited(rng, rng.choice(items[:25])[1], rng.randrange(8)) + "!! " + " ".join(rng.choices(words, k=10))
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "İ" * 40 + items[3][1].upper()), (503, "ab " * 300_000 + items[4][1]), (1, items[5][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("old"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = c.contamination(frame, bench).collect()
    assert len(got) == len(docs)
    for (i, text), row in zip(sorted(docs, key=repr), sorted(got, key=lambda r: repr((r.doc_id, r.text)))):
        plain, want = c.normal(text or ""), {}
        if len(plain) < 10_000:
            for number, item in items:
                pattern = c.normal(item or "")
                if len(pattern) >= c.LEAST_CHARS and (d := _distance(pattern, plain)) <= int(len(pattern) * c.SHARE):
                    want[number] = d
            assert {h.item_id: h.distance for h in row.hits} == want, (i, text)
        for h in row.hits:
            part = c.normal(text[h.start : h.end])
            assert _distance(c.normal(dict(items)[h.item_id]), part) <= h.distance
    assert {h.item_id for r in got if r.doc_id == 503 for h in r.hits} == {4}
    assert {h.item_id for r in got if r.doc_id == 502 for h in r.hits} == {3}


def test_short_items_stand_alone(spark):
    items = [(1, "What is the capital of Peru?"), (2, "日本の首都はどこですか"), (3, "cat"), (4, "?!"), (5, "Müller")]
    texts = ["Q: what is the CAPITAL of Peru", "what is the capital of Perus", "それで日本の首都はどこですかと聞いた", "concatenate", "a cat.", "MÜLLER", "Müllerin ?!", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = c.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [[(h.item_id, h.distance, r.text[h.start : h.end]) for h in r.hits] for r in got] == [
        [(1, 0, "what is the CAPITAL of Peru")], [], [(2, 0, "日本の首都はどこですか")], [], [(3, 0, "cat")], [(5, 0, "MÜLLER")], [], [],
    ]


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"quick brown fox jumps over the lazy dog {i}") for i in range(4)], "item_id long, text string")
    whole = c.contamination(docs, bench).select("hits").first()[0]
    monkeypatch.setattr(c, "BLOCK_CHARS", 50)
    assert sorted(c.contamination(docs, bench).select("hits").first()[0]) == sorted(whole)
    assert c.contamination(docs, bench.limit(0)).select(F.size("hits")).first()[0] == 0
    assert c.contamination(docs.limit(0), bench).count() == 0


def test_query_finds_every_whole_passage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in queries.op6(spark, SMALL).collect()}
    whole = {(d.doc_id, b.item_id) for d in docs for b in bench if len(c.normal(b.text)) >= c.LEAST_CHARS and b.text in (d.text or "")}
    assert whole <= found
