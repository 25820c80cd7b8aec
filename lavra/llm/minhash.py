"""Near duplicates by bottom-k sketches of one hash function.

Equal shingle sets form one class by a 128-bit fingerprint, so copies never meet pair by pair. A class keeps its
``SKETCH`` smallest shingle hashes. Two classes with Jaccard similarity of at least the threshold miss only so
many of each other's sketch values: no more than shingles of their union are outside of the intersection,
which is exact and decides for short texts, and no more than ``SKETCH`` less the ``least_shared`` of the
threshold, but with chance under ``MISSED``. So they share one of the rarest values, one more than may be
missed. Only those open an inverted list: frequent passages drop out without loss.

In each list every class is first held against the list's hub, the class whose values are the most
frequent. What the hubs join is one component; after that only pairs of different components are left,
which blocks of bounded size compare inside tasks. Pairs with a hub pass an estimate on the union sketch,
then the exact similarity on whole sets decides, as it does in the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lavra.llm.components import components
from lavra.llm.shingles import shingle_sets
from lavra.llm.words import slices
from lavra.session import stage

SKETCH = 32
MISSED = 1e-8  # chance that two long sets at the threshold share fewer sketch values than assumed
THRESHOLD = 85  # per cent
BLOCK = 1024  # classes in a part of a cluster
BLOCK_VALUES = 1 << 20  # and shingles in it, both about
COLUMNS = 8192
FILTER_BITS = 1 << 24  # of the Bloom filter that goes to all tasks, whatever the input


def _sketch_rows(key_type):
    fields = [("key", key_type), ("hash", pa.int64()), ("n_shingles", pa.int64())]
    schema = pa.schema([*fields, ("fp", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for start, stop in slices(texts):
                sets = shingle_sets(texts.slice(start, stop - start))
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                columns = [
                    batch.column(0).slice(start, stop - start),
                    batch.column(2).slice(start, stop - start),
                    [len(s) for s in sets],
                    prints,
                    [s[:SKETCH] for s in sets],
                ]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _spots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the filter."""
    h = h.view(np.uint64)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_of(hashes: DataFrame):
    """A Bloom filter over a column ``h``, as bytes; bits are gathered as distinct places, at most FILTER_BITS / 64 words."""

    def places(batches):
        for batch in batches:
            spots = np.unique(np.concatenate(_spots(batch.column(0).to_numpy(zero_copy_only=False))))
            bit = np.left_shift(np.uint64(1), (spots & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spots >> 6), pa.array(bit)], names=["word", "bit"])

    words = hashes.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table)


def _set_rows(shared):
    """Fingerprint and whole set of the rows whose hash may be wanted."""
    schema = pa.schema([("fp", pa.binary()), ("set", pa.binary())])

    def run(batches):
        table = shared.value
        for batch in batches:
            one, two = _spots(batch.column(0).to_numpy(zero_copy_only=False))
            here = [(table[x >> 6] >> (x & 63)) & 1 for x in (one, two)]
            texts = batch.column(1).filter(pa.array((here[0] & here[1]).astype(bool)))
            for start, stop in slices(texts):
                sets = [s.tobytes() for s in shingle_sets(texts.slice(start, stop - start))]
                prints = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _keyed(docs: DataFrame, key: str):
    """The key as the type it is compared in."""
    string = docs.schema[key].dataType.simpleString() == "string"
    return F.col(key) if string else F.col(key).cast("long")


def sketches(docs: DataFrame, *, key="doc_id", text="text") -> DataFrame:
    """Per row: ``key``, ``hash`` of the text, ``n_shingles``, fingerprint ``fp`` of the whole set, bottom-k ``sketch``."""
    string = docs.schema[key].dataType.simpleString() == "string"
    words = F.col(text).cast("string")
    rows = docs.select(_keyed(docs, key).alias("key"), words.alias("text"), F.xxhash64(words).alias("hash"))
    out = f"key {'string' if string else 'long'}, hash long, n_shingles long, fp binary, sketch array<long>"
    return rows.mapInArrow(_sketch_rows(pa.string() if string else pa.int64()), out)


def least_shared(threshold: int) -> int:
    """How many sketch values two sets at the threshold share, but with chance under ``MISSED`` (binomial tail)."""
    t, tail, shared = threshold / 100, 0.0, 0
    while shared < SKETCH:
        tail += math.comb(SKETCH, shared) * t**shared * (1 - t) ** (SKETCH - shared)
        if tail >= MISSED:
            break
        shared += 1
    return shared


def _prefix(n, threshold: int):
    """How many of its rarest sketch values a class must offer.

    Where every partner's sketch is its whole set, the least overlap of whole sets counts. Else each shingle
    of the union outside of the intersection, ``n * (100 - threshold) / threshold`` at most, may push one
    shared value out of a sketch.
    """
    whole = n - F.ceil(n * threshold / 100) + 1
    apart = F.floor(n * (100 - threshold) / threshold) + 1
    cut = F.least(apart, F.lit(SKETCH - least_shared(threshold) + 1))
    return F.when(n * 100 < (SKETCH + 1) * threshold, whole).otherwise(cut).cast("int")


def inverted_lists(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows ``(value, cid, n, popular)`` of the lists with two classes or more, rarest values only."""
    values = classes.select("cid", F.col("n_shingles").alias("n"), F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df"))
    shared = values.join(counts.where("df > 1"), "value")
    by_class = shared.groupBy("cid", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("known"), F.sum("df").alias("popular")
    )
    # Values of one class only are the rarest of all and open no list.
    alone = F.least("n", F.lit(SKETCH)) - F.size("known")
    kept = F.greatest(_prefix(F.col("n"), threshold) - alone, F.lit(0)).cast("int")
    kept = F.slice("known", F.lit(1), kept)
    return by_class.select("cid", "n", "popular", F.explode(kept).alias("k")).select(
        "cid", "n", "popular", F.col("k.value").alias("value"), F.col("k.df").alias("df")
    )


def _near_size(a, b, threshold: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def union_estimate(a, b):
    """Similarity estimated on the bottom-k of the union of two sketches."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.array_intersect(F.array_intersect(union, a), b)
    return F.size(both) / F.size(union)


def _least_estimate(threshold: int) -> float:
    """Six standard errors below the threshold: what it drops is no link but with chance under 1e-8."""
    t = threshold / 100
    return t - 6 * math.sqrt(t * (1 - t) / SKETCH)


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``(a, b)`` whose union sketch does not rule a link out."""
    side = classes.select("cid", "sketch", F.col("n_shingles").alias("n"))
    left = side.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = side.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    kept = pairs.join(left, "a").join(right, "b").where(_near_size(F.col("na"), F.col("nb"), threshold))
    return kept.where(union_estimate("sa", "sb") >= _least_estimate(threshold)).select("a", "b")


def _verified(threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        place, sets = None, {}
        for batch in batches:
            out_a, out_b = [], []
            columns = (batch.column(n).to_pylist() for n in ("block", "a", "b", "set"))
            for block, a, b, data in zip(*columns):
                if block != place:
                    place, sets = block, {}
                if b is None:
                    sets[a] = np.frombuffer(data, np.int64)
                    continue
                x, y = sets[a], sets[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= threshold * (len(x) + len(y) - common):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)

    return run


def _exact(pairs: DataFrame, sets: DataFrame, clusters: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose whole sets are similar enough.

    Pairs are dealt to blocks of nearby classes, each set goes once to a block that needs it, and a task
    holds the sets of one block at a time.
    """
    spot = F.concat_ws(":", "cluster", "part")
    at = clusters.select("cid", spot.alias("spot"))
    placed = (
        pairs.join(at.withColumnsRenamed({"cid": "a", "spot": "pa"}), "a")
        .join(at.withColumnsRenamed({"cid": "b", "spot": "pb"}), "b")
        .withColumn("block", F.concat_ws("|", F.least("pa", "pb"), F.greatest("pa", "pb")))
    )
    placed = stage(placed.select("block", "a", "b"), "pairs")
    needs = placed.select("block", "a").unionByName(placed.select("block", F.col("b").alias("a"))).distinct()
    loaded = needs.join(sets.withColumnRenamed("cid", "a"), "a").select("block", "a", F.lit(None).cast("long").alias("b"), "set")
    rows = loaded.unionByName(placed.select("block", "a", "b", F.lit(None).cast("binary").alias("set")))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verified(threshold), "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices of a bounded number of values at a time."""
    sets = left + right
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(place) > 1  # values of one set only are in no intersection
    number = np.cumsum(often) - 1
    inside = often[place]
    place, owner = number[place[inside]], owner[inside]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def _linking(rows, threshold: int):
    """Links of one block that join different components, no more than it takes to join them."""
    cid, comp, side, sets = rows
    left = [i for i, s in enumerate(side) if s < 2]
    right = [i for i, s in enumerate(side) if s > 0]
    if not left or not right:
        return
    common = _overlaps([sets[i] for i in left], [sets[i] for i in right])
    n = np.array([len(s) for s in sets], np.float32)
    union = n[left][:, None] + n[right][None, :] - common
    comps = np.array(comp)
    linked = (100 * common >= threshold * union) & (comps[left][:, None] != comps[right][None, :])
    root: dict[int, int] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            x = up
        return x

    for x, y in np.argwhere(linked):
        i, j = left[x], right[y]
        a, b = find(comp[i]), find(comp[j])
        if a != b:
            root[a] = b
            yield cid[i], cid[j]


def _blocks_linked(threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        place, rows = None, ([], [], [], [])

        def links():
            found = list(_linking(rows, threshold))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(2)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            names = ("block", "cid", "component", "side", "set")
            for block, cid, comp, side, data in zip(*(batch.column(x).to_pylist() for x in names)):
                if block != place:
                    if rows[0]:
                        yield links()
                    place, rows = block, ([], [], [], [])
                for column, x in zip(rows, (cid, comp, side, np.frombuffer(data, np.int64))):
                    column.append(x)
        if rows[0]:
            yield links()

    return run


def _across(lists: DataFrame, sets: DataFrame, clusters: DataFrame, joined: DataFrame, threshold: int) -> DataFrame:
    """Links between components that share an inverted list.

    Lists name the pairs of cluster parts that may hold such links, not pairs of classes. Each pair of
    parts is a block of bounded size: all its sets are compared at once, exactly, and only links that
    join components come back.
    """
    known = clusters.join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    # What is joined already stands apart, so that its parts need not be compared with each other.
    spot = F.concat_ws(":", "cluster", "part", F.isnull("component"))
    known = known.select("cid", spot.alias("spot"), F.coalesce("component", "cid").alias("component"))
    known = stage(known, "placed")
    spots = lists.select("value", "cid").join(known, "cid").groupBy("value", "spot")
    spots = spots.agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = spots.groupBy("value").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    spots = stage(spots.join(mixed.select("value"), "value"), "spots")
    other = spots.select("value", F.col("spot").alias("spot2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = "spot <= spot2 AND NOT (low = high AND low2 = high2 AND low = low2)"
    blocks = spots.join(other, "value").where(apart).select("spot", "spot2").distinct()
    blocks = stage(blocks.withColumn("block", F.concat_ws("|", "spot", "spot2")), "blocks")
    one = blocks.where("spot = spot2").select("block", "spot", F.lit(1).alias("side"))
    two = blocks.where("spot <> spot2")
    needs = one.unionByName(two.select("block", "spot", F.lit(0).alias("side"))).unionByName(
        two.select("block", F.col("spot2").alias("spot"), F.lit(2).alias("side"))
    )
    rows = known.join(sets, "cid").join(needs, "spot").select("block", "cid", "component", "side", "set")
    rows = rows.repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(_blocks_linked(threshold), "a long, b long")


def _grouped(docs: DataFrame, key: str, text: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and for each fingerprint its smallest key and its component."""
    rows = stage(sketches(docs, key=key, text=text), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("fp").agg(
        F.min("key").alias("first_key"), F.min("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    lists = stage(inverted_lists(classes, threshold), "lists")

    hubs = lists.groupBy("value").agg(F.max(F.struct("popular", "cid"))["cid"].alias("hub"), F.count("*").alias("m"))
    hubs = hubs.where("m > 1")
    star = lists.join(hubs, "value").where("cid <> hub").select("cid", "hub", "m")
    star = stage(star.groupBy("cid", "hub").agg(F.max("m").alias("m")), "star")
    # Classes near each other share a cluster, in parts of about BLOCK.
    home = star.groupBy("cid").agg(F.max(F.struct("m", "hub"))["hub"].alias("cluster"))
    sizes = home.join(classes.select("cid", "n_shingles"), "cid")
    size = sizes.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_VALUES)).alias("parts"))
    home = home.join(size, "cluster").select("cid", "cluster", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
    alone = star.select(F.col("hub").alias("cid")).distinct().join(home, "cid", "left_anti")
    clusters = home.unionByName(alone.select("cid", F.col("cid").alias("cluster"), F.lit(-1).cast("long").alias("part")))
    clusters = stage(clusters, "clusters")

    wanted = clusters.join(classes.select("cid", "fp", "first_key"), "cid").select("cid", "fp", "first_key")
    # Only documents whose key passes a filter of fixed size are shingled again; what it lets through
    # beyond the wanted ones, more as the input grows, is dropped by the join on fingerprints.
    passing = _filter_of(wanted.select(F.xxhash64("first_key").alias("h")))
    source = docs.select(F.xxhash64(_keyed(docs, key)).alias("h"), F.col(text).cast("string").alias("_text"))
    sets = source.mapInArrow(_set_rows(passing), "fp binary, set binary")
    sets = sets.join(wanted.select("cid", "fp"), "fp").groupBy("cid").agg(F.first("set").alias("set"))
    sets = stage(sets, "sets")

    pairs = star.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    links = stage(_exact(_estimated(pairs, classes, threshold), sets, clusters, threshold), "links")
    joined = stage(components(links), "components")

    more = stage(_across(lists, sets, clusters, joined, threshold), "links")
    joined = components(links.unionByName(more))

    named = classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    named = stage(named.select("fp", "first_key", F.coalesce("component", "cid").alias("component")), "named")
    return rows.drop("sketch"), named


def near_duplicates(docs: DataFrame, *, key="doc_id", text="text", threshold: int = THRESHOLD) -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id`` and ``kept``.

    Rows link when ``100 * intersection >= threshold * union`` of their shingle sets. The component is
    named by the smallest key in it. Null and wordless texts have no shingles, link with nothing and are
    kept. Repeated rows share a component; a repeated smallest key is kept each time. A null key counts
    as larger than all others and its row is kept only if it is linked with no row that has a key.
    Other columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    rows, named = _grouped(docs, key, text, threshold)
    lowest = named.groupBy("component").agg(F.min("first_key").alias("component_id"))
    out = rows.join(named.join(lowest, "component").select("fp", "component_id"), "fp", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("component_id"))
    out = out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, key="doc_id", text="text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one row of each component, that with the smallest key; all columns stay.

    Rows of equal key go by the hash of their text, null keys last, and of repeated rows one stays. Rows
    without shingles all stay. Any column names may be there.
    """
    rows, named = _grouped(docs, key, text, threshold)
    full = rows.where("n_shingles > 0").groupBy("fp", "key", "hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "hash", "n")
    chosen = full.join(named.select("fp", "component"), "fp").groupBy("component").agg(F.min(order).alias("m"))
    chosen = stage(chosen.select("m.key", "m.hash", "m.n"), "kept")
    plain = rows.where("n_shingles = 0").select("key", "hash").distinct()
    # Names that ``docs`` does not have, in any case.
    fresh = "kept"
    while any(c.lower().startswith(fresh) for c in docs.columns):
        fresh = f"_{fresh}"
    tagged = docs.withColumn(f"{fresh}_here", F.xxhash64(F.col(text).cast("string")))

    def among(kept):
        kept = kept.select(F.col("key").alias(f"{fresh}_key"), F.col("hash").alias(f"{fresh}_hash"))
        same = tagged[key].eqNullSafe(kept[f"{fresh}_key"]) & (tagged[f"{fresh}_here"] == kept[f"{fresh}_hash"])
        return tagged.join(kept, same, "left_semi").drop(f"{fresh}_here")

    out = among(chosen.where("n = 1").select("key", "hash").unionByName(plain))
    repeated = chosen.where("n > 1")
    return out if repeated.isEmpty() else out.unionByName(among(repeated).dropDuplicates([key, text]))
