import itertools
import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lavra.functions import encodings as en, markup

CHAINS = [(e,) for e in en.ENCODINGS] + list(itertools.product(en.ENCODINGS, repeat=2))
SOUND = [
    "naïve café, “quotes” — dash…", "Ні", "Ві, Ні. Її Ціль", "„DIÄ“ É»", "日本語のテキスト", "Ελληνικά κείμενα", "русский ёж «Ё»",
    "a√b", "┌─┐│ x │└─┘", "São João À»", "Смотри №1 ®", "", "plain", "שלום", "สวัสดี", "Привет, мир!", "x² ½ µ",
]
TEXTS = ["O João não está à mesa.", "Größe, Maß und Übermut", "“Curly” — it’s €5…", "Привет, мир! Ёжик", "Ελληνικά", "日本語のテキスト", "naïve café"]


@pytest.mark.parametrize("chain", CHAINS, ids="-".join)
def test_every_chain_is_undone(chain):
    for text in TEXTS:
        broken = text
        for encoding in chain:
            broken = en.misread(broken, encoding)
        assert broken != text and en.repaired(broken) == text


def test_three_layers_and_sound_texts():
    broken = TEXTS[0]
    for _ in range(3):
        broken = en.misread(broken, "windows-1252")
    assert en.repaired(broken) == TEXTS[0]
    assert [en.repaired(t) for t in SOUND] == SOUND


def test_columns(spark):
    rows = [(t, [t, None, "plain"]) for t in [*SOUND, *(en.misread(t, "mac-roman") for t in TEXTS)]] + [(None, None)]
    frame = spark.createDataFrame(rows, "t string, l array<string>")
    got = frame.select(markup.repair_encoding("t").alias("t"), markup.repair_encoding_each("l").alias("l")).collect()
    want = [*SOUND, *TEXTS, None]
    assert [r["t"] for r in got] == want
    assert [r["l"] for r in got] == [None if t is None else [t, None, "plain"] for t in want]


def test_given_tables_are_sound(spark):
    for name, column in (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")):
        table = spark.read.parquet(os.path.join(os.path.dirname(SMALL), "sf0.01", f"{name}.parquet"))
        changed = table.where(~markup.repair_encoding(column).eqNullSafe(F.col(column)))
        assert changed.count() == 0, name
