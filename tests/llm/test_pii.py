import re
import time

from pyspark.sql import functions as F

from conftest import SMALL
from lavra.llm import queries
from lavra.llm.pii import Feistel, Pseudonyms, _iban_rest, luhn, pseudonymize

TEXTS = {
    1: "mail ann.lee@mail6.example.com or Ann.Lee@mail6.example.com, ip 55.63.178.142.",
    2: "call +1 (319) 555-5132 with 4425414259157784 now\nagain 4425 4142 5915 7784",
    3: "born 1984-02-29, 29.2.1984 and 12/31/1999; not 2024-13-45 or 31.02.2001",
    4: "DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00, 123-45-6789",
    5: "1234567890123456 300.1.1.1 3.14159 1,234,567.89 v1.2.3",
    6: None,
    7: "",
    8: "x" * 1_000_000 + " 55.63.178.142",
}


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 97, 1000, 4096):
        assert sorted(map(Feistel(b"k", "t", size), range(size))) == list(range(size))
    assert [Feistel(b"k", "t", 1000)(i) for i in range(9)] != [Feistel(b"l", "t", 1000)(i) for i in range(9)]


def test_values_stay_valid_linked_and_in_format():
    change = Pseudonyms(b"key")
    out = {i: change(t) for i, t in TEXTS.items() if t is not None}
    for i, (text, spans) in out.items():
        assert re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", text.lower()))[:40].count("@") == TEXTS[i][:40].count("@")
        for kind, a, b in spans:
            assert TEXTS[i][a:b] not in text, (kind, TEXTS[i][a:b])
    assert [s[0] for s in out[1][1]] == ["email", "email", "ip"]
    assert [s[0] for s in out[2][1]] == ["phone", "card", "card"]
    cards = re.findall(r"(?<!\d)4[\d ]{15,18}\d?", out[2][0])
    plain = {re.sub(" ", "", c) for c in cards}
    assert len(plain) == 1 and luhn(plain.pop())
    assert [s[0] for s in out[3][1]] == ["date"] * 3 and "2024-13-45" in out[3][0] and "31.02.2001" in out[3][0]
    iso, german = re.search(r"\d{4}-\d\d-\d\d", out[3][0])[0], re.search(r"(\d+)\.(\d+)\.(\d{4})", out[3][0])
    assert iso == f"{german[3]}-{int(german[2]):02d}-{int(german[1]):02d}"
    iban = re.match(r"DE[0-9 ]+\d", out[4][0])[0]
    assert _iban_rest(iban.replace(" ", "")[:22]) == 1 and [s[0] for s in out[4][1]][0] == "iban"
    assert out[5] == (TEXTS[5], [])
    assert len({change(f"1.2.3.{i}")[0] for i in range(256)}) == 256


def test_rows_and_columns_pass_through(spark):
    frame = spark.createDataFrame(list(TEXTS.items()) + [(1, TEXTS[1])], "doc_id long, text string").withColumns({"pii": F.lit(1), "spans": F.lit("s")})
    got = pseudonymize(frame, b"key")
    assert got.columns == ["doc_id", "text", "spans", "pii"]
    rows = got.collect()
    assert len(rows) == 9 and len({r.text for r in rows if r.doc_id == 1}) == 1
    assert [(r.text, r.pii) for r in rows if r.doc_id in (6, 7)] == [(None, []), ("", [])]
    assert pseudonymize(frame.limit(0), b"key").count() == 0


def test_query_leaves_no_value_behind(spark):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    new = {r.doc_id: r.text for r in queries.op5(spark, SMALL).collect()}
    assert old.keys() == new.keys()
    for i, text in old.items():
        for value in re.findall(r"[\w.]+@[\w.]+\.com|\(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b", text or ""):
            # Sixteen digits without a right check digit are no card and stay.
            assert (value in new[i]) == (value.isdigit() and not luhn(value))


def test_percent_escapes_take_linear_time():
    change = Pseudonyms(b"key")
    begun = time.perf_counter()
    for text in ("3" + "%20" * 350_000, "a@" + "a." * 500_000 + "1", "9" * 1_000_000, "a@" * 500_000):
        assert change(text) == (text, [])
    assert time.perf_counter() - begun < 20
    text = "%3Ca%20" * 150_000 + "ann.lee@mail6.com" + "%20" * 350_000 + " é%20bob@mail6.com"
    new, spans = change(text)
    assert [text[a:b] for _, a, b in spans] == ["ann.lee@mail6.com", "bob@mail6.com"]
    assert "ann.lee" not in new and "bob@" not in new and len(new) == len(text)
    # One address is one value, wherever it stands.
    assert change("to ann.lee@mail6.com")[0][3:] in new
