"""Benchmark items inside documents, up to a number of edits.

An item of n characters may differ in ``k = floor(n * share)`` of them. Cut into k + 1 pieces, at least
one piece then stands in the document unchanged: an automaton over all pieces finds these, and Myers'
bit-parallel edit distance verifies the item around each. Both sides are compared in lower case with
each run of other characters than letters and digits as one space. Items shorter than ``LEAST_CHARS`` are
found as they stand only, between word bounds. Items reach the tasks in blocks of bounded size, one pass
over the documents per block.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHARE = 0.06
LEAST_CHARS = 32
BLOCK_CHARS = 1 << 20

_OTHER = re.compile(r"[\W_]+")
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def _original(text: str) -> list[int]:
    """For each character of ``normal(text)`` the place in ``text`` that it comes from."""
    low, source = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            low.append(x)
            source.append(i)
    joined = "".join(low)
    if joined != text.lower():  # a letter whose small form depends on its neighbours
        joined = text.lower()
    out, at = [], 0
    for m in _OTHER.finditer(joined):
        out += source[at : m.start()]
        out.append(source[m.start()])
        at = m.end()
    out += source[at:]
    return out[1:] if _OTHER.match(joined) else out


def distance_at(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to a substring, with the substring's last end; None beyond ``most``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        score += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(xv | plus) & full
        down = plus & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def pieces(item: str, share: float = SHARE) -> list[tuple[int, str]]:
    """Starts and texts of the k + 1 pieces."""
    n = int(len(item) * share) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _bounded(text: str, start: int, stop: int) -> bool:
    """Whether a piece of normal text stands on its own. Scripts from U+2E80 on write no spaces between words."""

    def apart(at):
        pair = text[max(at - 1, 0) : at + 1]
        return at in (0, len(text)) or " " in pair or max(pair) >= "\u2e80"

    return apart(start) and apart(stop)


class _Search:
    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items, self.share = items, share
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            for start, piece in pieces(text, share) if len(text) >= LEAST_CHARS else [(0, text)]:
                by_piece.setdefault(piece, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """Best verified hit per item: (item id, distance, start, end in the text)."""
        if not self.items:
            return []
        plain = normal(text)
        around: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(plain):
            for number, start in places:
                around.setdefault(number, set()).add(end + 1 - length - start)
        hits = []
        for number, starts in around.items():
            item = self.items[number][1]
            n, most = len(item), int(len(item) * self.share)
            if n < LEAST_CHARS:
                alone = min((s for s in starts if _bounded(plain, s, s + n)), default=None)
                if alone is not None:
                    hits.append((number, 0, alone, alone + n))
                continue
            exact = min((s for s in starts if s >= 0 and plain.startswith(item, s)), default=None)
            if exact is not None:
                hits.append((number, 0, exact, exact + n))
                continue
            best, upto = None, -1
            ordered = sorted(starts)
            for i, s in enumerate(ordered):
                if s <= upto:
                    continue
                # Neighbouring candidates share one window.
                last = s
                for x in ordered[i + 1 :]:
                    if x - last > n:
                        break
                    last = x
                upto = last
                low = max(0, s - most)
                found = distance_at(item, plain[low : last + n + most], most)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], low + found[1])
            if best:
                back = distance_at(item[::-1], plain[max(0, best[1] - n - most) : best[1]][::-1], most)
                hits.append((number, best[0], best[1] - (back[1] if back else n), best[1]))
        if not hits:
            return []
        source = _original(text)
        return sorted((self.items[k][0], d, source[a], source[b - 1] + 1) for k, d, a, b in hits)


_searches: dict[int, tuple] = {}


def _finder(shared, share: float):
    @F.arrow_udf("array<struct<item_id: long, distance: int, start: long, end: long>>")
    def find(texts: pa.Array) -> pa.Array:
        if id(shared) not in _searches:
            _searches.clear()
            _searches[id(shared)] = (shared, _Search(shared.value, share))
        search = _searches[id(shared)][1]
        names = ("item_id", "distance", "start", "end")
        return pa.array([[dict(zip(names, h)) for h in search(t.as_py())] for t in texts], _HITS)

    return find


def _blocks(items: DataFrame):
    held, size = [], 0
    for number, text in items.toLocalIterator():
        plain = normal(text)
        if not plain:
            continue
        if held and size + len(plain) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((number, plain))
        size += len(plain)
    yield held


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text="text", item="item_id", item_text="text", share: float = SHARE, out="hits"
) -> DataFrame:
    """Add ``hits``: per item found its id, edit distance and place (code points, end exclusive) in the text.

    Of several places the one with the least distance counts. Null texts have no hits, null items and those
    without a letter or digit are not found; those shorter than ``LEAST_CHARS`` normalised characters are
    found without edits, between word bounds. An
    equal item under two ids is found under both. Other columns pass through; one named ``hits`` is replaced.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("long"), F.col(item_text).cast("string"))
    found = []
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found.append(_finder(shared, share)(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    kept = [c for c in docs.columns if c != out]
    hits = F.concat(*found) if len(found) > 1 else found[0]
    return docs.select(*kept, hits.alias(out))
