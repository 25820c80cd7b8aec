import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lavra.functions import markup, text as tx
from lavra.operators import filters, measures
from lavra.operators.vocabulary import normalize, with_tokens

ODD = [
    "", " ", "\n\n", "a\x1cb\x1fc\x85d\xa0e　f g​h", "É o\tÊ  ß ſo", "x1y22", "😀 emoji", " z ",
    "  lead", "trail \r\n", "İstanbul", "one", "ΣΑΣ ςΣ the",
]


def _column(docs, texts, column):
    rows = docs(*texts).select("doc_id", column.alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_words_like_python(docs):
    assert _column(docs, ODD, tx.split_words("text")) == [t.split() for t in ODD]


def test_quick_classes_match_plain_ones(docs):
    rng = random.Random(7)
    points = [*range(0x00, 0x250), *range(0x2000, 0x2070), 0x1680, 0x3000, 0x2581, 0x660, 0x4E00, 0x1F600, 0x301]
    texts = ["".join(chr(rng.choice(points)) for _ in range(200)) for _ in range(50)]
    plain = F.regexp_extract_all("text", F.lit(tx.PRE_TOKEN), F.lit(0))
    assert _column(docs, texts, tx.raw_pre_tokens("text")) == _column(docs, texts, plain)
    assert _column(docs, texts, tx.split_words("text")) == [t.split() for t in texts]
    assert _column(docs, texts, tx.trim_space("text")) == [t.strip() for t in texts]


def test_normalise_sample(docs):
    decomposed = unicodedata.normalize("NFD", "Três ``vozes'' no Céu, ''Já'' \"AGORA\"")
    assert _column(docs, [decomposed], normalize("text")) == ['três "vozes" no céu, "já" "agora"']


def test_pre_tokens(docs):
    texts = ["linha7, 40%: sim...", "a▁b ▁c 1▁2 ▁▁", ""]
    want = ["▁linha ▁7 ▁, ▁40 ▁% ▁: ▁sim ▁. ▁. ▁.", "▁a ▁b ▁c ▁1 ▁ ▁2 ▁ ▁", ""]
    assert [" ".join(t) for t in _column(docs, texts, tx.pre_tokens("text"))] == want
    rows = with_tokens(docs(*texts).select("doc_id", "text")).collect()
    assert [" ".join(r["tokens"]) for r in sorted(rows)] == want
    assert _column(docs, texts, tx.count_pre_tokens("text")) == [10, 8, 0]


def test_compose_only_where_needed(docs):
    texts = ["plain", "é", None, "é", "ﬁ ̈́"]
    assert _column(docs, texts, markup.compose("text")) == [
        None if t is None else unicodedata.normalize("NFC", t) for t in texts
    ]


def test_compose_each(spark):
    df = spark.createDataFrame([(1, ["a", "é"]), (2, []), (3, None), (4, ["x"])], "k int, t array<string>")
    assert [r[0] for r in df.orderBy("k").select(markup.compose_each("t")).collect()] == [
        ["a", "é"], [], None, ["x"],
    ]


def test_markup(docs):
    texts = [
        "plain & simple", "<p>a<br>b &amp; c</p>", "<script>x<1</script>seen<style>p{}</style>", "<!-- no -->yes",
        "<ul><li>1<li>2</ul>", None, "a < b", "&#233;&eacute;", "<ruby>x<rt>hid</ruby>shown",
    ]
    want = ["plain & simple", "ab & c", "seen", "yes", "12", None, "a < b", "éé", "xshown"]
    assert _column(docs, texts, markup.strip_markup("text")) == want


@pytest.mark.parametrize("codec", ["latin-1", "cp1252"])
def test_mojibake(docs, codec):
    good = ["função é", "naïve – “quoted”", "plain", "日本語"]
    broken = []
    for t in good:
        raw = t.encode("utf-8")
        if codec == "latin-1":
            broken.append(raw.decode("latin-1"))
        else:
            broken.append("".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in raw))
    got = _column(docs, broken, tx.undo_mojibake("text"))
    assert got == good


def test_repair(docs):
    texts = ["It’s “fine”", "a\r\nb\rc", "x\x00y\x07", "ﬁn ＡＢ", "É normal", "caf\xe9 d\xe9j\xe0", "a\x1b[31mred"]
    want = ["It's \"fine\"", "a\nb\nc", "xy", "fin AB", "É normal", "café déjà", "ared"]
    assert _column(docs, texts, tx.repair_text("text")) == want


def test_paragraphs_flatten(spark):
    rows = [(1, ([["a", "b &amp; c"], ["d"]],)), (2, ([],)), (3, ([["It’s"]],))]
    df = spark.createDataFrame(rows, "doc_id long, text struct<paragraphs: array<array<string>>>")
    got = {r["doc_id"]: r["text"] for r in measures.join_paragraphs(df).collect()}
    assert got == {1: "a\nb & c\nd\n", 2: "", 3: "It's\n"}


def test_measures_like_python(docs):
    stop = ["the", "Of", "dass", "σας"]
    texts = [*ODD, "THE of cat OF daß", "ß" * 3 + " the"]
    folded = {s.casefold() for s in stop}
    got = measures.measure_documents(docs(*texts), min_words=0, stopwords=stop).collect()
    for r in got:
        words = texts[r["doc_id"]].split()
        assert r["num_words"] == len(words)
        assert r["stopwords"] == sum(w.casefold() in folded for w in words)
        if words:
            assert r["average"] == pytest.approx(sum(map(len, words)) / len(words), abs=1e-12)
        else:
            assert r["average"] is None
    assert len(got) == len(texts)


def test_paragraphs_need_two_words(docs):
    got = measures.measure_paragraphs(docs("one\n\n two words \nthe three words\n")).orderBy("para_idx").collect()
    assert [(r["para_idx"], r["text"], r["num_words"], r["stopwords"]) for r in got] == [
        (2, "two words", 2, 0), (3, "the three words", 3, 1),
    ]


def test_document_needs_hundred_words(docs):
    sizes = [99, 100, 101]
    got = measures.measure_documents(docs(*["w " * n for n in sizes])).collect()
    assert sorted(r["num_words"] for r in got) == [100, 101]


# Rows on the limits of each rule, and just beyond them.
RULE_LIMITS = {
    "phase1": ([(20, 2, 2.0), (1024, 2, 15.0)], [(19, 2, 5.0), (1025, 2, 5.0), (20, 1, 5.0), (20, 2, 1.999), (20, 2, 15.001)]),
    "phase2": ([(100, 2, 2.0), (50_000, 2, 15.0)], [(99, 2, 5.0), (100, 1, 5.0), (100, 2, 1.999), (100, 2, 15.001)]),
    "early": ([(20, 1, 2.0), (512, 1, 15.0)], [(19, 1, 5.0), (513, 1, 5.0), (20, 0, 5.0), (20, 1, 1.999)]),
    "short": ([(10, 2, 3.0), (19, 2, 10.0)], [(9, 2, 5.0), (20, 2, 5.0), (10, 1, 5.0), (10, 2, 2.999), (10, 2, 10.001)]),
}


@pytest.mark.parametrize("name", RULE_LIMITS)
def test_rule_limits(spark, name):
    kept, dropped = RULE_LIMITS[name]
    df = spark.createDataFrame(kept + dropped, "num_words long, stopwords long, average double")
    assert sorted(map(tuple, filters.apply_rule(df, name).collect())) == sorted(kept)


def test_short_or_cut_token_rows(spark):
    full, cut, short, tiny = [2] + [7] * 10 + [3, 0], [2] + [7] * 12, [2] + [7] * 8 + [3, 0, 0, 0], [2, 3, 0]
    df = spark.createDataFrame([(full,), (cut,), (short,), (tiny,)], "input_ids array<int>")
    assert [r[0] for r in filters.drop_bad_token_rows(df).collect()] == [full]


def test_repair_of_parts(spark):
    from lavra.functions import text as tx

    texts = ["funÃ§Ã£o e café 日", "itâ€™s 日", "«CAFÉ» 日 GRÄ«", "ðŸ˜€ 日", "plain", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.undo_mojibake("t").alias("o")).collect()
    assert [r.o for r in rows] == ["função e café 日", "it’s 日", "«CAFÉ» 日 GRÄ«", "😀 日", "plain", None]


def test_case_folding_on_every_assigned_code_point(spark):
    points = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    lines = ["".join(points[a : a + 200]) for a in range(0, len(points), 200)] + points[::7] + ["Straße", "ΣΑΣ", "İI", "ﬃ ŉ", "µ", "ſs", ""]
    frame = spark.createDataFrame([(t,) for t in lines], "t string")
    for before, after in frame.select("t", tx.fold_case("t")).collect():
        assert after == before.casefold(), [c for c in before if c.casefold() not in after]
