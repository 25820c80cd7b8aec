import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lavra.llm import lexical


def _terms(text):
    folded = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def _plainly(docs, items):
    counted = [(key, Counter(_terms(text))) for key, text in docs]
    counted = [(key, c) for key, c in counted if c]
    documents, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c in counted:
            m = 100 - 25 + (25 * c.total() * documents) // length
            score = 0
            for t in _terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -minus) for rank, (minus, _, _, key) in enumerate(sorted(found)[:20], 1)]
    return sorted(out, key=repr)


def _got(docs, items):
    return sorted(map(tuple, lexical.best_documents(docs, items).collect()), key=repr)


def _made(rng):
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 4))) for _ in range(60)] + ["Ünï", "日本語", "x9", "KK"]
    mark = [" ", "  ", "\n", "_", "-", ".", "\x00", "'", " ", "{", "`", "@"]
    text = lambda k: "".join(rng.choice([w, w.upper()]) + rng.choice(mark) for w in rng.choices(words, k=k))
    docs = [(rng.randrange(10**9), text(rng.randrange(1, 30))) for _ in range(400)]
    docs += [(i, docs[0][1]) for i in range(50)] + [(None, docs[0][1])] * 2 + [(7, docs[1][1])] * 3
    docs += [(1, None), (2, ""), (3, "?! ..."), (4, "ab"), (5, "  ab  "), (6, "ab " * 500_000 + "x9")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(30)] + [(50, None), (51, "--"), (0, "ab ab AB x9"), (None, "x9"), (52, "nowhere"), (53, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("chars", [lexical.BLOCK_CHARS, 40])
def test_against_brute_force(spark, monkeypatch, chars):
    docs, items = _made(random.Random(chars))
    monkeypatch.setattr(lexical, "BLOCK_CHARS", chars)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert _got(frame, asked) == _plainly(docs, items)


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3)], "doc_id long, text string, n int, item_id int, score int")
    items = spark.createDataFrame([(1, "b", 4)], "item_id long, text string, doc_id int")
    assert _got(docs, items) == _plainly([(1, "a b")], [(1, "b")])
    assert _got(docs.limit(0), items) == [] and _got(docs, items.limit(0)) == []


def test_long_texts_in_stretches(monkeypatch):
    known = [b"ab", "é".encode(), b"c" * 90]
    texts = pa.array(["ab " * 50 + "é", None, "c" * 90 + " ab", "", "b" * 200 + " ab"])
    whole = lexical.count_terms(texts, lexical.automaton(known), len(known))
    monkeypatch.setattr(lexical, "SCAN_BYTES", 16)
    parts = lexical.count_terms(texts, lexical.automaton(known), len(known))
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    assert whole[0].tolist() == [51, 0, 2, 0, 2]
    assert list(zip(*(x.tolist() for x in whole[1:]))) == [(0, 0, 50), (0, 1, 1), (2, 0, 1), (2, 2, 1), (4, 0, 1)]


def test_sums_beyond_doubles():
    # One row, one term, one item; the exact way must hold where doubles round.
    n, tf, worth = np.array([3]), np.array([3]), 3 * 10**9 // (3000 + 12 * 150)
    for exact, repeats in ((True, 5), (False, 10**6 + 1)):
        model = (np.array([10**6 + 1]), np.array([0, 1]), np.array([0]), np.array([repeats]), 1, 1, 1, exact)
        assert lexical.scores(n, np.array([0]), np.array([0]), tf, model).item() == (10**6 + 1) * worth * repeats
