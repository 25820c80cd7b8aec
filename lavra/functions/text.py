"""Text expressions built from JVM functions only."""

from __future__ import annotations

import functools
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# The white space on which Python's str.split() cuts.
WS_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_CLASS}]+"
# The same set for Java, where two ranges rule most letters out before the full list is walked.
WS_QUICK = rf"[\x09-\x20\x{{85}}-\x{{3000}}&&[{WS_CLASS}]]+"

# The Unicode White_Space property, which the pre-tokeniser cuts on.
WHITE_SPACE = (
    r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# A run of numbers, one punctuation mark, or a run of anything else; the meta symbol opens a new piece.
META = "▁"
_MARK = r"\p{P}$+<=>^`|~"
_OTHER = rf"[^\p{{N}}{_MARK}{META}{WHITE_SPACE}]"
PRE_TOKEN = rf"\p{{N}}+|[{_MARK}]|{META}?{_OTHER}+|{META}"
# The same matches for Java: plain letters are let through before the properties are asked.
PRE_TOKEN_QUICK = rf"{META}?[a-z{_OTHER}]+|[{_MARK}]|\p{{N}}+|{META}"


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def split_words(column) -> Column:
    """Words between white space; no empty words."""
    return F.filter(F.split(_col(column), WS_QUICK), lambda w: w != "")


def trim_space(column) -> Column:
    """Cut white space of every kind from both ends."""
    return F.regexp_replace(_col(column), rf"\A{WS_QUICK}|{WS_QUICK}\z", "")


@functools.cache
def _foldings() -> tuple[dict[str, str], dict[str, str], list[str]]:
    """Full case folding by rule: letters beyond ASCII that fold to one letter, and to several; and those that
    lower-casing does not fold, or may not in a JVM that does not know them yet."""
    folded = {c: c.casefold() for c in map(chr, range(0x80, sys.maxunicode + 1))}
    single = {c: f for c, f in folded.items() if c != f and len(f) == 1}
    several = {c: f for c, f in folded.items() if len(f) > 1}
    return single, several, [c for c, f in folded.items() if c.lower() != f or (c != f and c >= "\u2c00")]


def _ranges(letters) -> str:
    """Letters as the inside of a Java character class."""
    points, out = sorted(map(ord, letters)), []
    for point in points:
        if out and point == out[-1][1] + 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in out)


def fold_case(column) -> Column:
    """Full Unicode case folding, letter by letter.

    Lower-casing folds all but a few letters. Those that occur in running text are replaced after it; texts
    with any of the others pass one table of letters instead, and the letters that fold to several are met
    one character at a time, in texts that have one.
    """
    text = _col(column)
    single, several, unfolded = _foldings()
    few = {c: c.casefold() for c in unfolded if c < "\u0180" or c == "ς"}
    latin = F.lower(text)
    for letter, folded in few.items():
        latin = F.replace(latin, F.lit(letter), F.lit(folded))
    rare = [c for c in unfolded if c not in few]
    upper = "".join(map(chr, range(65, 91)))
    whole = F.translate(text, upper + "".join(single), upper.lower() + "".join(single.values()))
    whole = F.replace(whole, F.lit("ß"), F.lit("ss"))
    rest = {c: f for c, f in several.items() if c != "ß"}
    table = F.create_map(*(F.lit(x) for pair in rest.items() for x in pair))
    chars = F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0))
    each = F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    whole = F.when(whole.rlike(f"[{_ranges(rest)}]"), each).otherwise(whole)
    return F.when(text.rlike(rf"[\x{{180}}-\x{{10ffff}}&&[{_ranges(rare)}]]"), whole).otherwise(latin)


def lower(column) -> Column:
    """Lower case letter by letter: a final capital sigma gets no form of its own."""
    return F.lower(F.replace(_col(column), F.lit("Σ"), F.lit("σ")))


def stopword_hits(
    folded_words, stopwords: Mapping[str, Sequence[str]] | Sequence[str], lang=None, default: Sequence[str] | None = None
) -> Column:
    """Those of the (already case-folded) words that are stop words, repeats included.

    ``stopwords`` is one list, or a list per language with ``lang`` naming the row's language. Rows of
    another language, or of none, are held against ``default``: if not given, the words of all lists.
    Membership is a constant hash set inside the lambda, so no join is needed.
    """
    words = _col(folded_words)

    def hits(values: Sequence[str]) -> Column:
        listed = sorted({v.casefold() for v in values})
        return F.filter(words, lambda w: w.isin(listed))

    if not isinstance(stopwords, Mapping):
        return hits(stopwords)
    if default is None:
        default = sorted({w for values in stopwords.values() for w in values})
    branches = F.when(F.lit(False), F.array().cast("array<string>"))
    for code, values in stopwords.items():
        branches = branches.when(_col(lang) == code, hits(values))
    return branches.otherwise(hits(default))


def count_stopwords(folded_words, stopwords, lang=None) -> Column:
    """How many of the words are stop words, repeats included."""
    return F.size(stopword_hits(folded_words, stopwords, lang)).cast("long")


def straight_quotes(column) -> Column:
    """Paired back-ticks and paired apostrophes become a double quote."""
    return F.replace(
        F.replace(_col(column), F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"')
    )


def raw_pre_tokens(column) -> Column:
    """Pieces of a normalised text, not yet opened by the meta symbol."""
    # A space before a piece is passed over with it, which spares a search that fails at the space.
    return F.regexp_extract_all(_col(column), F.lit(f" ?({PRE_TOKEN_QUICK})"), F.lit(1))


def open_piece(piece) -> Column:
    """Put the meta symbol in front of a piece that does not begin with it."""
    piece = _col(piece)
    return F.when(F.startswith(piece, F.lit(META)), piece).otherwise(F.concat(F.lit(META), piece))


def pre_tokens(column) -> Column:
    """Pieces of a normalised text, each opened by the meta symbol."""
    return F.transform(raw_pre_tokens(column), open_piece)


def word_pre_tokens(column) -> Column:
    """The same of one word. Plain letters are one piece and need no search."""
    word = _col(column)
    return F.when(word.rlike(r"\A[a-z]+\z"), F.array(F.concat(F.lit(META), word))).otherwise(pre_tokens(word))


def count_pre_tokens(column) -> Column:
    return F.regexp_count(_col(column), F.lit(PRE_TOKEN_QUICK)).cast("long")


# The windows-1252 characters of the bytes 0x80-0x9f, and those bytes read as Latin-1.
CP1252_HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
# Curly quotes, Latin ligatures, line ends.
CURLY_SINGLE, CURLY_DOUBLE = "ʼ‘’‚‛", "“”„‟"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}
LINE_ENDS = r"\r\n|[\r\x{85}\x{2028}\x{2029}]"
CONTROLS = r"[\x00-\x08\x0b\x0e-\x1f\x7f\x{206a}-\x{206f}\x{feff}\x{fff9}-\x{fffc}]"
# Full-width forms sit at a constant distance from ASCII.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


_LATER = rf"[\x{{80}}-\x{{bf}}{CP1252_HIGH}]"
# Damage inside sound text. Only lead bytes that read as letters hardly ever met before such a mark are taken:
# Latin letters and marks (two bytes), punctuation (three), emoji (four).
DAMAGED = rf"(?:[\x{{c2}}\x{{c3}}]{_LATER}|\x{{e2}}[\x{{80}}-\x{{84}}€‚ƒ„]{_LATER}|\x{{f0}}[\x{{9f}}Ÿ]{_LATER}{_LATER})+"


def undo_mojibake(column) -> Column:
    """UTF-8 that was read as Latin-1 or windows-1252, read back as UTF-8.

    A text that as a whole maps to single bytes of valid UTF-8 is read back as a whole. In other texts
    runs that look damaged are read back each on its own, and the rest is kept.
    """
    text = _col(column)
    gaps, runs = F.split(text, DAMAGED, -1), F.regexp_extract_all(text, F.lit(DAMAGED), F.lit(0))
    mended = F.zip_with(gaps, F.transform(runs, lambda r: _undo(r, r)), lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
    return _undo(text, F.when(text.rlike(DAMAGED), F.array_join(mended, "")).otherwise(text))


def _undo(text: Column, otherwise: Column) -> Column:
    single = F.translate(text, CP1252_HIGH, CP1252_BYTES)
    looks_broken = text.rlike(r"[\x{c2}-\x{f4}]") & single.rlike(r"\A[\x00-\x{ff}]*\z")
    bytes_ = F.when(looks_broken, F.encode(single, "ISO-8859-1")).cast("string")
    return F.when(F.is_valid_utf8(bytes_), bytes_).otherwise(otherwise)


def repair_text(column) -> Column:
    """Undo mojibake, straighten quotes and line ends, narrow wide forms, drop control characters.

    Plain ASCII without control characters passes straight through. Composing to NFC is a separate step.
    """
    text = _col(column)
    out = undo_mojibake(text)
    out = F.regexp_replace(out, r"\x1b\[[0-9;]*[a-zA-Z]", "")
    for joined, parts in LIGATURES.items():
        out = F.replace(out, F.lit(joined), F.lit(parts))
    out = F.translate(out, WIDE, NARROW)
    out = F.translate(
        out, CURLY_SINGLE + CURLY_DOUBLE, "'" * len(CURLY_SINGLE) + '"' * len(CURLY_DOUBLE)
    )
    out = F.regexp_replace(out, LINE_ENDS, "\n")
    out = F.regexp_replace(out, CONTROLS, "")
    return F.when(text.rlike(r"[^\t\n\f\x20-\x7e]"), out).otherwise(text)
