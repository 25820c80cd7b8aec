"""Repair of conversation structure with the fewest edits.

Rows are sorted once by conversation and turn into range partitions, so that even one very long
conversation is spread over tasks, and cut into runs of a few dozen rows. Each run is a lattice of edits
solved by the auction algorithm in ``auction``. A conversation of one run is solved at once. For longer ones
the runs' least costs from state to state are folded from the last run to the first, which gives every run
its exit costs, and then the states reached are folded from the first to the last; each fold goes run by run
inside a range partition, then over partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lavra.llm import auction
from lavra.session import stage

_WHITE = "\t\n\x0b\x0c\r "
_LEGAL = ("su", "ua", "au")
# What a seeded hash does to a row.
DROP, EMPTY, STRIP, REPEAT, AS_USER = range(5)


def _name(column: Column) -> Column:
    """A conversation's id as a string that no other id, nor a missing one, shares."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _said(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame, *, key="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """The rows with faults dealt by crc32 of ``key:turn``, as columns ``key, turn, role, text``; nulls read as one space."""
    kind = (F.crc32(F.concat(_said(key), F.lit(":"), _said(turn)).cast("binary")) % 20).cast("int")
    rows = rows.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), _said(role).alias("role"), _said(text).alias("text"), kind.alias("kind"))
    rows = rows.where(F.col("kind") != DROP)
    changed = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == STRIP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "key", "turn", F.when(F.col("kind") == AS_USER, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(times).alias("copy")
    ).drop("copy")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: the run each lies in, named by its first row, and whether it may not follow the row before."""
    last, first, before = None, 0, ""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        names = batch.column("c")
        ahead = pa.concat_arrays([pa.array([last], names.type), names.slice(0, len(names) - 1)])
        new = pc.fill_null(pc.not_equal(names, ahead), True).to_numpy(zero_copy_only=False)
        place = batch.column("pos").to_numpy()
        heads = np.where(new, place, first if not new[0] else place[0])
        heads = np.maximum.accumulate(heads)
        runs = heads + (place - heads) // auction.RUN * auction.RUN
        initials = batch.column("init")
        pairs = pc.binary_join_element_wise(pa.concat_arrays([pa.array([before], initials.type), initials.slice(0, len(initials) - 1)]), initials, "")
        odd = ~pc.is_in(pairs, pa.array(_LEGAL, pairs.type)).to_numpy(zero_copy_only=False) & ~new
        last, first, before = names[-1].as_py(), int(heads[-1]), initials[-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(odd)], names=[*batch.schema.names, "run", "odd"])


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of ``key, turn, role, text`` in stored order: name ``c``, place ``pos``, range partition, run and faults of their own."""
    ending = F.rtrim(F.col("text"), F.lit(_WHITE))
    rows = rows.select(
        _name(F.col("key")).alias("c"), "turn", "role", "text",
        F.unhex(F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary"))).alias("fp"),
        F.substring("role", 1, 1).alias("init"), (ending == "").alias("blank"), (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The row number keeps many equal rows from meeting in one partition.
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("fp")]
    rows = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row")
    rows = rows.drop("row").withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return stage(rows.mapInArrow(_numbered, f"{kinds}, run long, odd boolean"), "ordered")


def _runs(ordered: DataFrame) -> DataFrame:
    """Runs as code strings with the counts of their faults."""
    rows = ordered.select("c", "part", "run", "pos", "init", "blank", "cut", "odd", "fp")
    seen = rows.groupBy("c", "fp").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(seen, ["c", "fp"], "left")
    again = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    cut = F.col("cut") & ~F.col("blank") & ~again
    place = F.when(F.col("init") == "s", 1).when(F.col("init") == "u", 2).when(F.col("init") == "a", 3).otherwise(4)
    code = F.substring(F.lit(auction.CODES), place + F.when(F.col("blank") | again, 8).when(cut, 4).otherwise(0), F.lit(1))
    rows = rows.select("c", "part", "run", "pos", code.alias("code"), "blank", again.alias("again"), cut.alias("cut"), "odd", "init")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    counts = [F.sum(F.col(a).cast("long")).alias(b) for a, b in (("blank", "blank"), ("again", "duplicate"), ("cut", "truncated"), ("odd", "illegal"))]
    ends = [F.min_by("init", "pos").alias("head"), F.max_by("init", "pos").alias("tail")]
    return stage(rows.groupBy("c", "part", "run").agg(F.array_join(listed, "").alias("codes"), *counts, *ends), "runs")


def _transferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = auction.transfers(batch.column("codes").to_pylist()).reshape(-1, 16)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(costs) + 1) * 16, pa.int32()), pa.array(costs.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "v"])


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs over one run and the next."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), auction.FAR)


def _total_costs(values: list[list[int]]) -> list[int]:
    total = np.where(np.eye(4, dtype=bool), 0, auction.FAR)
    for v in values:
        total = _then(total, np.array(v).reshape(4, 4))
    return total.ravel().tolist()


def _exit_costs(values: list[list[int]], after: list[int]) -> list[list[int]]:
    out, cost = [], np.array(after)
    for v in reversed(values):
        out.append(cost.tolist())
        cost = np.minimum((np.array(v).reshape(4, 4) + cost).min(axis=1), auction.FAR)
    return out[::-1]


def _total_states(values: list[list[int]]) -> list[int]:
    total = list(range(4))
    for v in values:
        total = [v[s] for s in total]
    return total


def _entry_states(values: list[list[int]], before: list[int]) -> list[list[int]]:
    out, state = [], before[0]
    for v in values:
        out.append([state])
        state = v[state]
    return out


def _fold(runs: DataFrame, total, deal, begin: list[int]) -> DataFrame:
    """Of rows ``(c, part, run, v)`` in order: ``(c, run, x)``, what ``deal`` hands to each run.

    Lists are bounded: the runs of a conversation inside one range partition, then its partitions.
    """

    def totals(batches):
        for batch in batches:
            lists = [total([x["v"] for x in row]) for row in batch.column("l").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=["c", "part", "l", "t"])

    def outer(batches):
        for batch in batches:
            for c, row in zip(batch.column("c").to_pylist(), batch.column("l").to_pylist()):
                values = deal([x["t"] for x in row], begin)
                yield pa.RecordBatch.from_pylist([{"c": c, "part": x["part"], "x": v} for x, v in zip(row, values)], _OUTER)

    def inner(batches):
        for batch in batches:
            for c, row, x in zip(*(batch.column(n).to_pylist() for n in ("c", "l", "x"))):
                values = deal([r["v"] for r in row], x)
                yield pa.RecordBatch.from_pylist([{"c": c, "run": r["run"], "x": v} for r, v in zip(row, values)], _INNER)

    listed = runs.groupBy("c", "part").agg(F.sort_array(F.collect_list(F.struct("run", "v"))).alias("l"))
    kind = "array<struct<run:bigint,v:array<bigint>>>"
    parts = stage(listed.mapInArrow(totals, f"c string, part int, l {kind}, t array<bigint>"), "parts")
    whole = parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "t"))).alias("l"))
    dealt = whole.mapInArrow(outer, "c string, part int, x array<bigint>")
    return parts.join(dealt, ["c", "part"]).select("c", "l", "x").mapInArrow(inner, "c string, run long, x array<bigint>")


_OUTER = pa.schema([("c", pa.string()), ("part", pa.int32()), ("x", pa.list_(pa.int64()))])
_INNER = pa.schema([("c", pa.string()), ("run", pa.int64()), ("x", pa.list_(pa.int64()))])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(c, run, codes, x, entries)``: costs, edits and exits from each of the entries."""
    for batch in batches:
        codes, exits, entries = (batch.column(n).to_pylist() for n in ("codes", "x", "entries"))
        times = [len(e) for e in entries]
        at = np.repeat(np.arange(len(codes)), times)
        entry = np.array([s for e in entries for s in e], np.int64)
        cost, edits, ends = auction.solve([codes[i] for i in at.tolist()], entry, np.array(exits, np.int64).reshape(-1, 4)[at])
        bounds = pa.array(np.concatenate([[0], np.cumsum(times)]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, v) for v in (pa.array(cost), pa.array(edits, pa.string()), pa.array(ends))]
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("run"), *lists], names=["c", "run", "cost", "edits", "ends"])


_SOLVED = "c string, run long, cost array<bigint>, edits array<string>, ends array<bigint>"


def _plan(runs: DataFrame) -> DataFrame:
    """Per run: the state it is entered in, its edits, and the least cost from there to the conversation's end."""
    counted = runs.groupBy("c").agg(F.count("*").alias("n"), F.max("run").alias("last"))
    counted = stage(counted.where("n > 1"), "long")
    end, zero = F.array(*(F.lit(int(x)) for x in auction.END)).cast("array<bigint>"), F.array(F.lit(0).cast("long"))
    single = runs.join(counted, "c", "left_anti").select("c", "run", "codes", end.alias("x"), zero.alias("entries"))
    single = single.mapInArrow(_solved, _SOLVED)
    tail = F.element_at(F.array(*(F.lit(t) for t in auction.TAIL)), (F.col("ends")[0] + 1).cast("int"))
    single = single.select("c", "run", F.lit(0).cast("long").alias("entry"), F.concat(F.col("edits")[0], tail).alias("edits"), F.col("cost")[0].alias("cost"))

    long = runs.join(counted.select("c"), "c", "left_semi").select("c", "part", "run", "codes")
    costs = stage(long.mapInArrow(_transferred, "c string, part int, run long, codes string, v array<bigint>"), "transfers")
    exits = _fold(costs.drop("codes"), _total_costs, _exit_costs, auction.END.tolist())
    every = F.array(*(F.lit(s) for s in range(4))).cast("array<bigint>")
    solved = costs.join(exits, ["c", "run"]).select("c", "run", "codes", "x", every.alias("entries")).mapInArrow(_solved, _SOLVED)
    solved = stage(solved.join(costs.select("c", "run", "part"), ["c", "run"]), "solved")
    entries = _fold(solved.select("c", "part", "run", F.col("ends").alias("v")), _total_states, _entry_states, [0])
    at = (F.col("entry") + 1).cast("int")
    chosen = solved.join(entries.select("c", "run", F.col("x")[0].alias("entry")), ["c", "run"]).join(counted.select("c", "last"), "c")
    tail = F.element_at(F.array(*(F.lit(t) for t in auction.TAIL)), (F.element_at("ends", at) + 1).cast("int"))
    edits = F.concat(F.element_at("edits", at), F.when(F.col("run") == F.col("last"), tail).otherwise(""))
    chosen = chosen.select("c", "run", "entry", edits.alias("edits"), F.element_at("cost", at).alias("cost"))
    return single.unionByName(chosen)


class _Rewriter:
    """Applies the edits of sorted records: a run's edits (no role), then its rows. Yields ``(c, run, edit, role, text)``."""

    def __init__(self):
        self.c, self.run, self.edits, self.state = None, 0, iter(""), 0

    def _next(self) -> str:
        self.state = int(auction.NEXT[self.state])
        return auction.NAMES[self.state]

    def rest(self):
        for edit in self.edits:
            yield self.c, self.run, edit, self._next(), ""

    def __call__(self, c, run, edits, entry, role, text):
        if edits is not None:
            yield from self.rest()
            self.c, self.run, self.edits, self.state = c, run, iter(edits), entry
            return
        for edit in self.edits:
            if edit == "I":
                yield c, run, edit, self._next(), ""
                continue
            if edit == "R":
                yield c, run, edit, self._next(), text
            elif edit == "K":
                if self.state == auction.START and role.startswith("s"):
                    self.state = auction.SYSTEM
                else:
                    self._next()
                yield c, run, edit, role, text
            return


_FIELDS = ("c", "run", "edits", "entry", "role", "text")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rewriter, names = _Rewriter(), ("c", "run", "edit", "role", "text")
    schema = pa.schema([(n, pa.int64() if n == "run" else pa.string()) for n in names])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        columns = zip(*(batch.column(n).to_pylist() for n in _FIELDS))
        rows = [out for record in columns for out in rewriter(*record)]
        if rows:
            yield batch_of(rows)
    rows = list(rewriter.rest())
    if rows:
        yield batch_of(rows)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a conversation; rows stream through, whatever its length."""
    rewriter, state = _Rewriter(), [None, None, True]

    def close():
        return [(state[0], state[1].hexdigest())] if state[1] else []

    def take(row):
        if not state[2]:
            state[1].update(b"\n")
        state[1].update(f"{row[3]}:{row[4]}".encode())
        state[2] = False

    def batch_of(rows):
        return pa.RecordBatch.from_pylist([{"c": c, "sha": s} for c, s in rows], pa.schema([("c", pa.string()), ("sha", pa.string())]))

    for batch in batches:
        done = []
        for record in zip(*(batch.column(n).to_pylist() for n in _FIELDS)):
            if record[0] != state[0]:
                for row in rewriter.rest():
                    take(row)
                rewriter.edits = iter("")
                done += close()
                state[:] = [record[0], hashlib.sha256(), True]
            for row in rewriter(*record):
                take(row)
        if done:
            yield batch_of(done)
    for row in rewriter.rest():
        take(row)
    if state[1]:
        yield batch_of(close())


def _records(ordered: DataFrame, plan: DataFrame, *keys: str) -> DataFrame:
    """Runs' edits and rows together, dealt by ``keys``, each run's edits before its rows."""
    none = F.lit(None)
    edits = plan.select("c", "run", F.lit(-1).cast("long").alias("pos"), "edits", F.col("entry").cast("int").alias("entry"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    rows = ordered.select("c", "run", "pos", none.cast("string").alias("edits"), none.cast("int").alias("entry"), "role", "text")
    return edits.unionByName(rows).repartition(*keys).sortWithinPartitions("c", "run", "pos").select(*_FIELDS)


class Repair:
    """Stored tables of one repair; see ``repair``."""

    def __init__(self, ordered: DataFrame, runs: DataFrame, plan: DataFrame):
        self.ordered, self.runs, self.plan = ordered, runs, plan

    def rows(self) -> DataFrame:
        """The repaired rows: conversation name ``c``, ``run`` in order, ``at`` in the run, ``edit``, ``role``, ``text``."""
        out = _records(self.ordered, self.plan, "c", "run").mapInArrow(_rewritten, "c string, run long, edit string, role string, text string")
        return out.withColumn("at", F.monotonically_increasing_id())

    def digests(self) -> DataFrame:
        """``(c, sha)``: SHA-256 of the repaired rows as ``role:text`` lines. A digest is read in order, so by one task, which streams."""
        return _records(self.ordered, self.plan, "c").mapInArrow(_digested, "c string, sha string")

    def summaries(self) -> DataFrame:
        """Per conversation name: gaps, counts of faults, illegal pairs, cost, and the edits as ``audit``."""
        turns = self.ordered.where("turn IS NOT NULL").groupBy("c", "turn").agg(F.lit(1).alias("one")).groupBy("c")
        gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
        counts = self.runs.groupBy("c").agg(*(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")))
        # Pairs over the edge of two range partitions.
        edges = self.runs.groupBy("c", "part").agg(F.min_by("head", "run").alias("head"), F.max_by("tail", "run").alias("tail"))
        edges = edges.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "head", "tail"))).alias("l")).where(F.size("l") > 1)
        pairs = F.zip_with(F.slice("l", F.lit(1), F.size("l") - 1), F.slice("l", F.lit(2), F.size("l") - 1), lambda a, b: F.concat(a["tail"], b["head"]))
        edges = edges.select("c", F.size(F.filter(pairs, lambda x: ~x.isin(*_LEGAL))).cast("long").alias("over"))
        listed = F.sort_array(F.collect_list(F.struct("run", "edits")))
        plans = self.plan.groupBy("c").agg(F.min_by("cost", "run").alias("cost"), F.array_join(F.transform(listed, lambda x: x["edits"]), "").alias("audit"))
        out = counts.join(plans, "c").join(gaps, "c", "left").join(edges, "c", "left")
        return out.select(
            "c", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
            (F.col("illegal") + F.coalesce("over", F.lit(0))).alias("illegal"), "cost", "audit",
        )


def repair(rows: DataFrame) -> Repair:
    """Least edits that make each conversation of ``key, turn, role, text`` read ``(system? (user assistant)+)?``.

    A row's first fault counts: blank, duplicate of an earlier row, truncated. Blank and duplicate rows must
    go; a truncated row costs extra where it stays. Rows go by turn, nulls first; equal turns by role and a
    hash of role and text. Among the cheapest edits those least in ASCII are taken. Nulls must have been
    replaced in role and text; a null key is a conversation of its own. Empty tables give empty tables.
    """
    ordered = _ordered(rows)
    runs = _runs(ordered)
    return Repair(ordered, runs, stage(_plan(runs), "plan"))


def repair_report(
    conversations: DataFrame, *, key="conv_id", turn="turn", role="role", text="text"
) -> DataFrame:
    """One row for every key of ``conversations``: what repairing its rows after ``damage`` takes.

    Columns: key, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``. A key without rows after damage has zeros, an empty audit and the digest of
    nothing; a null key is one conversation. Rows that repeat are rows of their own. Other columns are not
    read, so their names cannot clash.
    """
    done = repair(damage(conversations, key=key, turn=turn, role=role, text=text))
    found = done.summaries().join(done.digests(), "c")
    ids = conversations.select(F.col(key).alias("key")).groupBy("key").agg(F.lit(1).alias("one")).select("key", _name(F.col("key")).alias("c"))
    out = ids.join(found, "c", "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("key").alias(key), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
