import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from conftest import SMALL
from lavra.llm import auction, conversations, queries

WORD = re.compile(r"[^\x20\x09-\x0D]")


def _cheapest(codes, entry=0, exits=(0, 6, 3, 0)):
    """(cost, edits, exit) by trying all edits, one row after the other."""

    @functools.cache
    def best(at, state, inserts=2):
        found = []
        if at == len(codes):
            return (exits[state], "", state)
        code = codes[at]
        follows = 3 if state == 2 else 2
        found.append((4, "D", at + 1, state))
        if not code.isdigit():
            more = 3 if code.isupper() else 0
            found.append((3 + more, "R", at + 1, follows))
            if code.lower() == "s" and state == 0:
                found.append((more, "K", at + 1, 1))
            elif code.lower() == {2: "u", 3: "a"}[follows]:
                found.append((more, "K", at + 1, follows))
        out = []
        for cost, edit, i, s in found:
            c, e, x = best(i, s)
            out.append((cost + c, edit + e, x))
        if inserts:  # more than two before a row only add to the cost
            c, e, x = best(at, follows, inserts - 1)
            out.append((3 + c, "I" + e, x))
        return min(out)

    return best(0, entry)


def test_auction_against_trying_all():
    rng = random.Random(1)
    codes = ["".join(rng.choices(auction.CODES, k=rng.randrange(9))) for _ in range(800)] + ["".join(rng.choices("suaUA0", k=40)) for _ in range(20)]
    cost, edits, _ = auction.solve(codes, [0] * len(codes), [auction.END] * len(codes))
    for code, c, e in zip(codes, cost.tolist(), edits):
        want = _cheapest(code)
        assert (want[0], want[1]) == (c, e), code
    some = [c for c in codes[:80] if c]
    for code, costs in zip(some, auction.transfers(some).tolist()):
        for entry in range(4):
            for leave in range(4):
                want = _cheapest(code, entry, tuple(0 if leave == x else 10**9 for x in range(4)))[0]
                assert costs[entry][leave] == want or (want >= 10**9 and costs[entry][leave] == auction.FAR)


def _plainly(rows):
    """rows: (conv, turn, role, text). One sorted tuple a conversation, as the report has them."""
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, said in kept.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in said if t is not None}
        codes, seen, counts = "", set(), [0, 0, 0]
        for _, role, text in said:
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            chars = WORD.findall(text)
            if not chars or (role, text) in seen:
                counts[1 if chars else 0] += 1
                letter = str("suao".index(letter))
            elif chars[-1] not in ".!?":
                counts[2] += 1
                letter = letter.upper()
            seen.add((role, text))
            codes += letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, leave = _cheapest(codes)
        audit += ("", "II", "I", "")[leave]
        lines, state, at = [], 0, 0
        for edit in audit:
            follows = 3 if state == 2 else 2
            if edit in "IR":
                state = follows
                lines.append(f"{'user' if state == 2 else 'assistant'}:{said[at][2] if edit == 'R' else ''}")
            elif edit == "K":
                state = 1 if state == 0 and said[at][1].startswith("s") else follows
                lines.append(f"{said[at][1]}:{said[at][2]}")
            at += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(frame):
    return sorted(map(tuple, conversations.repair_report(frame).collect()), key=repr)


def _made(rng, convs):
    rows, texts = [], ["Yes.", "no", "", " \n", "Why?", "so it is!", None, "é.", "x" * 50, "Fine.  \n"]
    for conv in range(convs):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randrange(5)
        for turn, role in enumerate(roles):
            role = rng.choice(["system", "user", "assistant", "tool", "", None]) if rng.random() < 0.2 else role
            text = rng.choice(texts) if rng.random() < 0.4 else f"Turn {turn} of {conv}."
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, text))
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (-1, None, "user", "one."), (-1, None, "user", "one."), (10**12, 10**12, "user", None)]
    rng.shuffle(rows)
    return rows


KIND = "conv_id long, turn long, role string, text string"


def test_report_against_brute_force(spark):
    rows = _made(random.Random(2), 400)
    assert _got(spark.createDataFrame(rows, KIND).repartition(5)) == _plainly(rows)


@pytest.mark.parametrize("run", [1, 3, 32])
def test_long_conversations_in_runs(spark, monkeypatch, run):
    rng = random.Random(run)
    rows = _made(rng, 30)
    for conv in (1000, 1001):
        rows += [(conv, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Yes.", "no", "", f"{t}.", f"{t}", f"{t}!"])) for t in range(150)]
    rows += [(1002, t, "user", f"{t}.") for t in range(90)] + [(1003, 5, "user", "same.")] * 90
    monkeypatch.setattr(auction, "RUN", run)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, KIND)
        assert _got(frame) == _plainly(rows)
        done = conversations.repair(conversations.damage(frame))
        lines = defaultdict(list)
        for r in done.rows().orderBy("c", "run", "at").collect():
            lines[r.c].append(f"{r.role}:{r.text}")
        digests = {r.c: r.sha for r in done.digests().collect()}
        for c, sha in digests.items():
            assert hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == sha
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_conversation_spreads_over_tasks(spark):
    rows = spark.range(0, 20_000, 1, 4).selectExpr("1L AS key", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = conversations.repair(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in done.ordered.groupBy("part").count().collect()]
    assert len(parts) > 4 and max(parts) < 8_000
    assert done.runs.count() >= 20_000 // auction.RUN
    only = done.summaries().first()
    assert (only.cost, only.illegal, only.audit) == (0, 0, "K" * 20_000)


def test_empty_table_and_clashing_names(spark):
    assert _got(spark.createDataFrame([], KIND)) == []
    frame = spark.createDataFrame([(1, 0, "user", "a.", 1, 2, 3)], KIND + ", key int, c int, run int")
    assert _got(frame) == _plainly([(1, 0, "user", "a.")])


def test_whole_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13(spark, SMALL).collect()), key=repr) == _plainly(rows)
