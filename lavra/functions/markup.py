"""The two text steps Spark has no expression for: markup to text, and canonical composition."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from lavra.functions.encodings import repaired, suspicious
from lavra.functions.text import _col, repair_text

# Elements whose text is not part of the page text, and elements that never hold text.
_HIDDEN = frozenset("script style template rt rp".split())
_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)


class _PageText(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)
            self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.hidden -= closed in _HIDDEN
                if closed == tag:
                    break

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and not self.hidden:
            self.parts.append(data[6:])


def _page_text(markup: str | None) -> str | None:
    if markup is None:
        return None
    page = _PageText()
    page.feed(markup)
    page.close()
    return "".join(page.parts)


def offsets(sizes: pa.Array) -> pa.Array:
    """Start of each list in the flattened values, and their end."""
    ends = pc.cumulative_sum(pc.fill_null(sizes, 0)).cast(pa.int32())
    return pa.concat_arrays([pa.array([0], pa.int32()), ends])


def relist(lists: pa.Array, values: pa.Array) -> pa.Array:
    """New values, one per flattened value, in the shape of ``lists``; a null list stays null."""
    starts = offsets(pc.list_value_length(lists))
    return pa.ListArray.from_arrays(starts, values, mask=lists.is_null())


def _nfc(texts: pa.Array) -> pa.Array:
    """Per string in the standard library: Arrow's own kernel leaves text decomposed."""
    composed = (None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist())
    return pa.array(composed, pa.string())


@F.pandas_udf(T.StringType())
def _strip(markup: pd.Series) -> pd.Series:
    return markup.map(_page_text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _strip_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda strings: None if strings is None else [_page_text(s) for s in strings])


@F.arrow_udf(T.StringType())
def _compose(text: pa.Array) -> pa.Array:
    return _nfc(text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _compose_each(texts: pa.Array) -> pa.Array:
    return relist(texts, _nfc(texts.flatten()))


def _only_where(test: Column, text: Column, apply) -> Column:
    """Send just the rows that need it through Python; the others travel as null and stay as they are."""
    return F.coalesce(apply(F.when(test, text)), text)


def strip_markup(column) -> Column:
    """Text of a page: tags, comments, scripts and styles out, entities decoded."""
    text = _col(column)
    return _only_where(text.rlike("[<&]"), text, _strip)


def compose(column) -> Column:
    """NFC. No code point under U+0300 changes, so only text beyond it is sent to the kernel."""
    text = _col(column)
    return _only_where(text.rlike(r"[^\x00-\x{2ff}]"), text, _compose)


def compose_each(column) -> Column:
    """NFC of every string in an array."""
    texts = _col(column)
    needs = F.array_join(texts, "").rlike(r"[^\x00-\x{2ff}]")
    return _only_where(needs, texts, _compose_each)


def _normal_form(form: str):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def apply(texts: pa.Array) -> pa.Array:
        strings = (None if t is None else unicodedata.normalize(form, t) for t in texts.flatten().to_pylist())
        return relist(texts, pa.array(strings, pa.string()))

    return apply


def normal_form_each(column, form: str) -> Column:
    """Any of the four Unicode normal forms of every string in an array. ASCII is left as it is."""
    if form == "NFC":
        return compose_each(column)
    texts = _col(column)
    return _only_where(F.array_join(texts, "").rlike(r"[^\x00-\x7f]"), texts, _normal_form(form))


def _each_repaired(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else repaired(t) for t in texts.to_pylist()), pa.string())


@F.arrow_udf(T.StringType())
def _repair(texts: pa.Array) -> pa.Array:
    return _each_repaired(texts)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _repair_each(texts: pa.Array) -> pa.Array:
    return relist(texts, _each_repaired(texts.flatten()))


def repair_encoding(column) -> Column:
    """UTF-8 read in wrong encodings, up to three times over, read back.

    The chain of encodings is searched for; only texts with a pair of characters that a wrong decoding makes
    are looked at. A text in which sound letters beyond ASCII are many is left to ``repair_text``.
    """
    text = _col(column)
    return _only_where(text.rlike(suspicious()), text, _repair)


def repair_encoding_each(column) -> Column:
    """The same for every string in an array."""
    texts = _col(column)
    return _only_where(F.exists(texts, lambda t: t.rlike(suspicious())), texts, _repair_each)


def clean_text(column) -> Column:
    """Markup out, broken encoding repaired, composed."""
    return compose(repair_text(repair_encoding(strip_markup(column))))


def clean_each(column) -> Column:
    """The same for every string in an array."""
    texts = _col(column)
    marked = F.exists(texts, lambda t: t.rlike("[<&]"))
    plain = _only_where(marked, texts, _strip_each)
    return compose_each(F.transform(repair_encoding_each(plain), repair_text))
