from pyspark.sql import functions as F

from conftest import SMALL
from lavra.llm import licenses, queries


def _found(spark, *texts, **columns):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = licenses.license_scan(frame.withColumns({c: F.lit(v) for c, v in columns.items()})).collect()
    return {(r.doc_id, r.license): (round(r.dice, 3), r.n_units) for r in out}


def test_notices_as_lines_blocks_and_texts(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    got = _found(
        spark, "Some words.\nReleased under the MIT License.\nMore words.", "prose here\n\n" + mit.replace(" to ", "\nto ") + "\n\nprose", mit,
        "LICENSED under the apache license version 2.0", "the license of the car", None, "", "\n\n", wrapped[:40],
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", row=1, part=2, n=3, bigram=4, u=5,
    )
    assert got[0, "MIT"] == (1.0, 1) and got[1, "MIT"][0] == 1.0 and got[2, "MIT"] == (1.0, 1)
    assert got[3, "Apache-2.0"] == (1.0, 1)
    # Two equal lines, one after the other; the block of both has each bigram twice.
    assert got[9, "CC-BY-NC-4.0"][0] == 1.0 and got[9, "CC-BY-NC-4.0"][1] >= 2
    assert {k[0] for k in got} == {0, 1, 2, 3, 9}


def test_dice_at_its_bound(spark):
    # Five words are four bigrams; four of five words kept share three of them: 2 * 3 / (4 + 3).
    got = _found(spark, "Released under the MIT", "Released under a MIT License")
    assert got == {(0, "MIT"): (round(6 / 7, 3), 1)}


def test_notice_inside_longer_parts(spark):
    # In a longer line, over line ends inside a paragraph, at both ends of a text, and next to repeated anchors.
    long = "The engine of the car was cold, and the driver waited for it. " * 3
    got = _found(
        spark, f"Copyright 2020 by us. Licensed under CC BY 4.0. See the file for more. {long}", f"{long}\nThis work is licensed under the GNU General\nPublic License, version 3. {long}",
        f"Released under the MIT License. {long}", f"{long} Released under the MIT License.", f"{long} the MIT License {long}", "license. " * 500 + f"{long} licensed under the MIT license {long}",
    )
    assert {k: v for k, v in got.items() if v[0] == 1.0} == {(0, "CC-BY-4.0"): (1.0, 1), (1, "GPL-3.0"): (1.0, 1), (2, "MIT"): (1.0, 1), (3, "MIT"): (1.0, 1), (5, "MIT"): (1.0, 1)}
    assert not {k for k in got if k[0] == 4}


def test_repeats_count(spark):
    # One bigram, however often it stands there, is one of a template's four.
    assert _found(spark, "the MIT License " * 30, "Released under the MIT License. " * 2) == {(1, "MIT"): (1.0, 1)}


def test_empty_repeated_and_long(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    notice = "Released under the MIT License."
    frame = spark.createDataFrame([(1, notice), (1, notice), (None, notice), (2, "word " * 400_000 + "\n" + notice)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_units) for r in licenses.license_scan(frame).collect()), key=str)
    assert got == [(1, 2), (2, 1), (None, 1)]


def test_main_path_is_native(spark):
    plan = queries.op4(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
