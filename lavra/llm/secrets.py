"""Secrets in texts: named patterns, and candidate strings of high entropy. Built-in functions only.

A candidate is a run of key-like characters. A window slides over it; the counts of its characters are
updated for the one that enters and the one that leaves, and with them the Shannon entropy. Its best
window decides, by a threshold for its character class. Well-known harmless shapes are suppressed, and
windows near the marks of made-up values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lavra.session import fence

# The base patterns, with the part whose length counts and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Least entropy in bits of the best window, by character class.
HEX_BITS, MIXED_BITS = 3.0, 3.7
# Harmless as a whole: ids in UUID form, numbers, words and paths without digits.
ALLOWED = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[^0-9]*$|^[^A-Za-z]*$"
# Marks of made-up values and runs. They clear the windows within NEAR characters, not all of a long
# candidate; a folder that is named by such a word clears only itself.
_MADE_UP = r"example|sample|dummy|placeholder|changeme"
HARMLESS = rf"(?i:{_MADE_UP}|x{{6}}|0{{6}}|abcdefgh|01234567|12345678)"
NEAR = 40
FOLDER = rf"(?:^|(?<=/))[A-Za-z_-]*(?i:{_MADE_UP})[A-Za-z_-]*/"
CLEARED = rf".{{0,{NEAR}}}{HARMLESS}.{{0,{NEAR}}}"

_SPAN = "array<struct<start:int,rank:int,stop:int>>"


# Values scanned one after another; longer arrays are scanned in parts of this size, then put together.
_PART = 128


def _lengths(text: Column, pattern: str) -> Column:
    """Lengths of what lies before each match and of the match, in turn."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.array(g, h)))


def _grow(values: Column, combine) -> Column:
    """``values`` combined from the first to each; costs the square of the length."""
    last = lambda out: F.try_element_at(out, F.lit(-1))
    return F.aggregate(
        values,
        F.array().cast("array<int>"),
        lambda out, x: F.concat(out, F.array(F.when(F.size(out) > 0, combine(last(out), x)).otherwise(x))),
    )


def _running(rows: DataFrame, columns: list[str], combine) -> DataFrame:
    """Each array of integers in ``columns`` combined from its first value to each, by an associative
    ``combine``: within parts, over the ends of the parts, and both together. The work grows with the
    length, not with its square, as long as there are fewer parts than values in thousands of parts.
    """
    kept = [c for c in rows.columns if c not in columns]

    def parts(name):
        whole = F.col(name)
        last = F.greatest(F.ceil(F.size(whole) / _PART).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: _grow(F.slice(whole, i * _PART + 1, F.lit(_PART)), combine))

    rows = fence(rows, *[parts(c).alias(c) for c in columns], keep=kept)
    ends = [_grow(F.transform(c, lambda p: F.try_element_at(p, F.lit(-1))), combine).alias(f"{c}_ends") for c in columns]
    rows = fence(rows, *ends, keep=[*kept, *columns])

    def joined(name):
        before = F.concat(F.array(F.lit(None).cast("int")), F.col(f"{name}_ends"))
        shifted = F.zip_with(
            F.col(name),
            F.slice(before, F.lit(1), F.size(name)),
            lambda p, b: F.when(b.isNull(), p).otherwise(F.transform(p, lambda x: combine(b, x))),
        )
        return F.flatten(shifted).alias(name)

    return fence(rows, *[joined(c) for c in columns], keep=kept)


def _spans(edges: Column, rank: int) -> Column:
    """(start, rank, stop) from running sums of ``_lengths``: starts and stops in turn."""
    starts = F.filter(edges, lambda _, i: i % 2 == 0)
    stops = F.filter(edges, lambda _, i: i % 2 == 1)
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("stop")))


def _bits(count: Column) -> Column:
    """count * log2(count), and 0 for 0."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(0.0)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits over all windows of ``window`` characters of ``ALPHABET``.

    The sum of count * log2(count) follows the counts of the entering and the leaving character.
    """
    # Places in the alphabet, from 1; the split gives single characters.
    table = F.create_map(*[F.lit(x) for i, c in enumerate(ALPHABET, 1) for x in (c, i)])
    places = F.transform(F.split(text, "(?<=.)(?=.)"), lambda c: F.element_at(table, c))
    moves = F.zip_with(
        places,
        F.concat(F.array_repeat(F.lit(0), window), places),
        lambda enter, leave: F.struct(enter.alias("enter"), F.coalesce(leave, F.lit(0)).alias("leave")),
    )
    moves = F.filter(moves, lambda m: m["enter"].isNotNull())
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(float("inf")).alias("least")
    )

    def step(s, m):
        old_in = F.element_at(s["counts"], m["enter"])
        entered = s["sum"] + _bits(old_in + 1) - _bits(old_in)
        leaves = m["leave"] > 0
        old_out = F.element_at(s["counts"], F.greatest(m["leave"], F.lit(1))) + F.when(m["leave"] == m["enter"], 1).otherwise(0)
        total = F.when(leaves, entered + _bits(old_out - 1) - _bits(old_out)).otherwise(entered)
        counts = F.transform(
            s["counts"],
            lambda c, i: c + F.when(i + 1 == m["enter"], 1).otherwise(0) - F.when(i + 1 == m["leave"], 1).otherwise(0),
        )
        n = s["n"] + 1
        least = F.when(n >= window, F.least(s["least"], total)).otherwise(s["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), n.alias("n"), least.alias("least"))

    return F.aggregate(moves, start, step, lambda s: F.lit(math.log2(window)) - s["least"] / window)


def _long_enough(places: Column, sizes: Column, least: int) -> Column:
    fitting = F.zip_with(places, sizes, lambda p, n: F.when(n >= least, p))
    return F.filter(fitting, lambda p: p.isNotNull())


def count_of(spans, kind: str) -> Column:
    """How many spans are of a kind."""
    rank = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def secret_scan(docs: DataFrame, *, key="doc_id", text="text") -> DataFrame:
    """Per row: key, ``base`` and ``more``, arrays of (start, rank, stop) of the named patterns and of
    high-entropy strings that overlap none of them; code points, stop exclusive, ordered.

    Rank is the place of the kind in ``BASE``, with entropy last. Null texts are empty and have no
    spans; rows are kept one for one, other columns are not read.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    # Cheap tests decide which texts are searched in full.
    rows = fence(
        rows,
        F.when(t.rlike("[:=]"), t.rlike(ASSIGN)).otherwise(False).alias("_assign"),
        t.contains("AKIA").alias("_access"),
        t.rlike("[0-9a-f]{32}").alias("_hex"),
        t.rlike(CANDIDATE).alias("_entropy"),
    )
    found, sizes = [], []
    for kind, pattern, group, least in BASE:
        if group:
            sizes.append(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), F.length))
        else:
            # Matches are maximal runs, so the shortest one wanted can be asked for directly.
            head, run = pattern[: pattern.index("[")], pattern[pattern.index("[") : -1]
            pattern = f"{head}{run}{{{least - len(head)},}}"
        found.append(F.when(F.col(f"_{kind}"), _lengths(t, pattern)))
    found.append(F.when(F.col("_entropy"), _lengths(t, CANDIDATE)))
    words = F.when(F.col("_entropy"), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))
    none = F.array().cast("array<int>")
    edges = [f"_edges{rank}" for rank in range(len(found))]
    rows = fence(
        rows,
        *[F.coalesce(c, none).alias(name) for c, name in zip(found, edges)],
        F.coalesce(F.when(F.col("_assign"), sizes[0]), none).alias("_sizes"),
        F.coalesce(words, F.array().cast("array<string>")).alias("_words"),
        keep=[key],
    )
    rows = _running(rows, edges, lambda a, b: a + b)
    named = [_spans(F.col(name), rank) for rank, name in enumerate(edges[:-1])]
    named[0] = _long_enough(named[0], F.col("_sizes"), BASE[0][3])
    rows = fence(
        rows, F.sort_array(F.concat(*named)).alias("base"), _spans(F.col(edges[-1]), len(BASE)).alias("_places"), keep=[key, "_words"]
    )
    # Named spans and candidates in one order, the named first where starts are equal. A candidate is free
    # if no named span before it reaches into it and the next one starts behind it: candidates lie apart,
    # so one that starts inside it comes right after it.
    marked = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("no"), s["stop"].alias("stop"))),
        F.transform("_places", lambda s, i: F.struct(s["start"].alias("start"), (i + 1).alias("no"), s["stop"].alias("stop"))),
    )
    rows = fence(rows, F.when(F.size("_places") > 0, F.sort_array(marked)).otherwise(F.slice(marked, 1, 0)).alias("_order"))
    rows = fence(rows, F.transform("_order", lambda o: F.when(o["no"] == 0, o["stop"]).otherwise(0)).alias("_reach"))
    rows = _running(rows, ["_reach"], F.greatest)
    around = F.arrays_zip(F.col("_order").alias("here"), F.slice("_order", F.lit(2), F.size("_order")).alias("next"), F.col("_reach").alias("reach"))
    free = F.filter(
        around,
        lambda a: (a["here"]["no"] > 0)
        & (a["reach"] <= a["here"]["start"])
        & ~F.coalesce((a["next"]["no"] == 0) & (a["next"]["start"] < a["here"]["stop"]), F.lit(False)),
    )
    rows = fence(rows, F.transform(free, lambda a: a["here"]["no"]).alias("_free"), keep=[key, "base", "_places", "_words"])
    strong = F.filter("_free", lambda no: _strong(F.element_at("_words", no)))
    return rows.select(key, "base", F.transform(strong, lambda no: F.element_at("_places", no)).alias("more"))


def _strong(word: Column) -> Column:
    """Whether a candidate, less what its harmless parts clear, has a window of high entropy."""
    least = F.when(word.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
    rest = F.when(word.rlike(HARMLESS), F.flatten(F.transform(F.split(word, FOLDER), lambda w: F.split(w, CLEARED)))).otherwise(F.array(word))
    left = F.filter(rest, lambda w: F.length(w) >= WINDOW)
    return ~word.rlike(ALLOWED) & F.exists(left, lambda w: window_entropy(w) >= least)


KINDS = (*[b[0] for b in BASE], "entropy")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:stop, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"]))
    return F.array_join(parts, ",")
