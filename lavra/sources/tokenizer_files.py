"""Tokenizer files: a vocabulary with its normaliser, pre-tokeniser, template and decoder as one JSON text.

Reading turns each part into column expressions and a vocabulary table; a part that has no such expression
here raises when the file is read, so a loaded file gives the same ids as any other reader of the format.
Writing takes a vocabulary of this library. A file is one JSON text, so its vocabulary is one that may pass
through the driver, which is checked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lavra import schemas
from lavra.functions import tokens as tk
from lavra.functions.markup import normal_form_each
from lavra.functions.text import META, WHITE_SPACE, lower
from lavra.operators.encoding import load_pieces, piece_lookup, unigram_encoder, word_encoder
from lavra.operators.vocabulary import BROADCAST_PIECES
from lavra.session import fence

FILE = "tokenizer.json"
_MARK = r"\p{P}$+<=>^`|~"
_WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"

Step = Callable[[Column], Column]


class UnknownPart(ValueError):
    """A part of a tokenizer file that has no expression here."""


def _literal(text: str) -> str:
    """A regular expression for exactly this text, in Java's syntax."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def _only(part: dict, known: dict) -> None:
    """Options beyond those listed must have the listed values."""
    for name, value in part.items():
        if name != "type" and name in known and known[name] is not ... and value != known[name]:
            raise UnknownPart(f"{part['type']} with {name} = {value!r}")
        if name != "type" and name not in known:
            raise UnknownPart(f"{part['type']} with {name}")


def _normalizer(part: dict | None) -> list[Step]:
    """Steps over an array of strings."""
    if part is None:
        return []
    kind = part["type"]
    if kind == "Sequence":
        return [step for inner in part["normalizers"] for step in _normalizer(inner)]
    if kind == "Replace" and set(part["pattern"]) == {"String"}:
        old, new = part["pattern"]["String"], part["content"]
        return [lambda texts: F.transform(texts, lambda t: F.replace(t, F.lit(old), F.lit(new)))] if old else []
    if kind == "Lowercase":
        return [lambda texts: F.transform(texts, lower)]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [lambda texts: normal_form_each(texts, kind)]
    if kind == "Prepend":
        return [lambda texts: F.transform(texts, lambda t: F.when(t != "", F.concat(F.lit(part["prepend"]), t)).otherwise(t))]
    if kind == "Strip":
        ends = [rf"\A[{WHITE_SPACE}]+"] * part["strip_left"] + [rf"[{WHITE_SPACE}]+\z"] * part["strip_right"]
        return [lambda texts, end=end: F.transform(texts, lambda t: F.regexp_replace(t, end, "")) for end in ends]
    raise UnknownPart(f"normalizer {kind}")


def _each_match(pattern: str) -> Step:
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pre_tokenizer(part: dict | None) -> list[Step]:
    """Steps from a string to an array of strings, each applied to every piece of the one before."""
    if part is None:
        return []
    kind = part["type"]
    if kind == "Sequence":
        return [step for inner in part["pretokenizers"] for step in _pre_tokenizer(inner)]
    if kind == "WhitespaceSplit":
        return [_each_match(f"[^{WHITE_SPACE}]+")]
    if kind == "Whitespace":
        return [_each_match(f"[{_WORD}]+|[^{_WORD}{WHITE_SPACE}]+")]
    if kind == "Punctuation":
        _only(part, {"behavior": "Isolated"})
        return [_each_match(f"[{_MARK}]|[^{_MARK}]+")]
    if kind == "Digits":
        return [_each_match(r"\p{N}|\P{N}+" if part["individual_digits"] else r"\p{N}+|\P{N}+")]
    if kind == "Metaspace":
        mark = part["replacement"]
        _only(part, {"replacement": ..., "prepend_scheme": ..., "split": ..., "add_prefix_space": ..., "str_rep": mark})
        scheme = part.get("prepend_scheme", "always" if part.get("add_prefix_space", True) else "never")
        if scheme not in ("always", "never"):
            raise UnknownPart(f"Metaspace with prepend_scheme = {scheme!r}")

        def opened(text: Column) -> Column:
            text = F.replace(text, F.lit(" "), F.lit(mark))
            if scheme == "always":
                text = F.when(F.startswith(text, F.lit(mark)) | (text == ""), text).otherwise(F.concat(F.lit(mark), text))
            if not part.get("split", True):
                return F.array(text)
            return F.regexp_extract_all(text, F.lit(f"{_literal(mark)}[^{_literal(mark)}]*|[^{_literal(mark)}]+"), F.lit(0))

        return [opened]
    raise UnknownPart(f"pre-tokenizer {kind}")


def _chain(steps: list[Step], text: Column) -> Column:
    pieces = F.array(text)
    for step in steps:
        pieces = F.flatten(F.transform(pieces, step))
    return F.filter(pieces, lambda p: p != "")


def _template(parts: list[dict], specials: dict) -> list[tuple[list[int] | str, int]]:
    out = []
    for part in parts:
        if "SpecialToken" in part:
            one = part["SpecialToken"]
            out.append((specials[one["id"]]["ids"], one["type_id"]))
        else:
            out.append((part["Sequence"]["id"], part["Sequence"]["type_id"]))
    return out


@dataclass
class TokenizerFile:
    """A tokenizer as read from a file; ``vocab`` is its vocabulary table."""

    vocab: DataFrame
    model: str
    unknown: int | None
    specials: dict[str, int] = field(default_factory=dict)
    normalizers: list[Step] = field(default_factory=list)
    pre_tokenizers: list[Step] = field(default_factory=list)
    single: list = field(default_factory=lambda: [("A", 0)])
    pair: list = field(default_factory=lambda: [("A", 0), ("B", 1)])
    meta: str | None = None
    meta_prefix: bool = True
    max_length: int | None = None

    def tokens(self, text) -> Column:
        """Pre-tokens of a text. Added tokens that stand in the text as written are pieces of their own."""
        text = F.col(text) if isinstance(text, str) else text
        raw = F.array(text)
        if self.specials:
            found = "|".join(map(_literal, sorted(self.specials, key=len, reverse=True)))
            gaps, marks = F.split(text, found, -1), F.regexp_extract_all(text, F.lit(f"(?:{found})"), F.lit(0))
            both = F.flatten(F.zip_with(gaps, marks, lambda gap, mark: F.array(gap, mark)))
            raw = F.when(text.rlike(found), F.filter(both, lambda t: t.isNotNull() & (t != ""))).otherwise(raw)
        normal = raw
        for step in self.normalizers:
            normal = step(normal)
        names = sorted(self.specials)

        def cut(before: Column, after: Column) -> Column:
            pieces = _chain(self.pre_tokenizers, after)
            return F.when(before.isin(names), F.array(before)).otherwise(pieces) if names else pieces

        return F.flatten(F.zip_with(raw, normal, cut))

    def encode(self, docs: DataFrame, *, text="text", out="ids") -> DataFrame:
        """Replace a text by its ids without the template's tokens; null texts give null."""
        encoder = word_encoder if self.model == "word" else unigram_encoder
        coded = encoder(self.vocab, unknown=self.unknown, specials=self.specials)
        others = [c for c in docs.columns if c != text]
        fresh = "_tokens"
        while fresh in docs.columns:
            fresh = f"_{fresh}"
        rows = fence(docs, self.tokens(text).alias(fresh), keep=others)
        return fence(rows, coded(F.col(fresh)).alias(out), keep=[c for c in others if c != out])

    def _filled(self, parts, first: Column, second: Column | None, of) -> Column:
        sides = {"A": first, "B": second}
        return F.concat(*(of(sides[what] if isinstance(what, str) else what, kind) for what, kind in parts))

    def framed(self, ids) -> Column:
        """Ids in the template of single texts, cut to the file's length if it has one."""
        ids = F.col(ids) if isinstance(ids, str) else ids
        if self.max_length is not None:
            added = sum(len(what) for what, _ in self.single if not isinstance(what, str))
            ids = tk.truncate(ids, self.max_length, added)
        return self._filled(self.single, ids, None, lambda what, _: what if isinstance(what, Column) else F.array(*map(F.lit, what)))

    def framed_pair(self, first, second) -> Column:
        """Ids of two texts in the template of pairs, longest side cut first if the file has a length."""
        first, second = self._cut(first, second)
        return self._filled(self.pair, first, second, lambda what, _: what if isinstance(what, Column) else F.array(*map(F.lit, what)))

    def pair_types(self, first, second) -> Column:
        first, second = self._cut(first, second)
        return self._filled(
            self.pair, first, second, lambda what, kind: F.array_repeat(F.lit(kind), F.size(what) if isinstance(what, Column) else F.lit(len(what)))
        )

    def _cut(self, first, second) -> tuple[Column, Column]:
        first, second = (F.col(c) if isinstance(c, str) else c for c in (first, second))
        if self.max_length is None:
            return first, second
        added = sum(len(what) for what, _ in self.pair if not isinstance(what, str))
        n, m = tk.truncated_pair_sizes(first, second, self.max_length, added)
        return F.slice(first, F.lit(1), n), F.slice(second, F.lit(1), m)

    def decode(self, ids, *, skip_specials: bool = True) -> Column:
        """Ids to text."""
        ids = F.col(ids) if isinstance(ids, str) else ids
        if skip_specials and self.specials:
            ids = F.filter(ids, lambda x: ~x.isin(*self.specials.values()))
        pieces = piece_lookup(self.vocab)(ids)
        if self.meta is None:
            return F.array_join(pieces, " ")
        spaced = F.transform(pieces, lambda p, i: F.when(F.lit(self.meta_prefix) & (i == 0) & F.startswith(p, F.lit(self.meta)), F.substring(p, len(self.meta) + 1, 1 << 30)).otherwise(p))
        return F.replace(F.array_join(spaced, ""), F.lit(self.meta), F.lit(" "))


def _model(part: dict) -> tuple[str, list[tuple[str, float]], int | None]:
    """Kind, pieces with scores in id order, and the unknown piece's id."""
    kind = part["type"]
    if kind == "Unigram":
        if part.get("byte_fallback"):
            raise UnknownPart("Unigram with byte_fallback")
        return "unigram", [(p, float(s)) for p, s in part["vocab"]], part["unk_id"]
    if kind == "WordLevel":
        ids = part["vocab"]
        pieces = sorted(ids, key=ids.get)
        if [ids[p] for p in pieces] != list(range(len(pieces))):
            raise UnknownPart("WordLevel with gaps in its ids")
        return "word", [(p, 0.0) for p in pieces], ids.get(part["unk_token"])
    raise UnknownPart(f"model {kind}")


def parse_tokenizer(spark: SparkSession, text: str) -> TokenizerFile:
    """A tokenizer from the JSON text of a file."""
    whole = json.loads(text)
    model, pieces, unknown = _model(whole["model"])
    if unknown is None:
        raise UnknownPart("a model without an unknown piece")
    known = {p: i for i, (p, _) in enumerate(pieces)}
    specials = {}
    for added in whole.get("added_tokens") or ():
        if any(added.get(option) for option in ("single_word", "lstrip", "rstrip", "normalized")):
            raise UnknownPart(f"added token {added['content']!r} with options")
        if added["id"] == len(pieces):
            pieces.append((added["content"], 0.0))
        elif known.get(added["content"]) != added["id"]:
            raise UnknownPart(f"added token {added['content']!r} beyond the vocabulary")
        specials[added["content"]] = added["id"]
    if len(pieces) > BROADCAST_PIECES:
        raise ValueError(f"a vocabulary beyond {BROADCAST_PIECES} rows has no place in a tokenizer file")
    columns = {
        "id": pa.array(range(len(pieces)), pa.int32()),
        "piece": [p for p, _ in pieces],
        "score": [s for _, s in pieces],
        "is_special": [p in specials for p, _ in pieces],
    }
    out = TokenizerFile(spark.createDataFrame(pa.table(columns), schemas.VOCAB), model, unknown, specials)
    out.normalizers, out.pre_tokenizers = _normalizer(whole.get("normalizer")), _pre_tokenizer(whole.get("pre_tokenizer"))
    if after := whole.get("post_processor"):
        if after["type"] != "TemplateProcessing":
            raise UnknownPart(f"post-processor {after['type']}")
        out.single, out.pair = (_template(after[n], after["special_tokens"]) for n in ("single", "pair"))
    if decoder := whole.get("decoder"):
        if decoder["type"] != "Metaspace":
            raise UnknownPart(f"decoder {decoder['type']}")
        out.meta = decoder["replacement"]
        out.meta_prefix = decoder.get("prepend_scheme", "always" if decoder.get("add_prefix_space", True) else "never") != "never"
    if cut := whole.get("truncation"):
        if (cut.get("direction", "Right"), cut.get("strategy", "LongestFirst"), cut.get("stride", 0)) != ("Right", "LongestFirst", 0):
            raise UnknownPart("truncation other than of the longest side's end")
        out.max_length = cut["max_length"]
    return out


def _file(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path if path.endswith(".json") else f"{path.rstrip('/')}/{FILE}")
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def load_tokenizer(spark: SparkSession, path: str) -> TokenizerFile:
    """A tokenizer from a file, or from the file in a folder, on any file system Spark knows."""
    file, store = _file(spark, path)
    stream = store.open(file)
    try:
        return parse_tokenizer(spark, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def tokenizer_text(vocab: DataFrame, *, model="unigram", max_length: int | None = None) -> str:
    """The JSON text of a vocabulary of this library, with its normaliser, pre-tokeniser, template and decoder."""
    pieces = load_pieces(vocab)
    if pieces is None:
        raise ValueError(f"a vocabulary beyond {BROADCAST_PIECES} rows has no place in a tokenizer file")
    unknown = tk.SPECIAL_TOKENS[tk.UNK]
    meta = {"type": "Metaspace", "replacement": META, "prepend_scheme": "always", "split": True}

    def frame(*names):
        out = []
        for name, kind in names:
            out.append({"Sequence" if name in "AB" else "SpecialToken": {"id": name, "type_id": kind}})
        return out

    start, end = tk.SPECIAL_TOKENS[tk.CLS], tk.SPECIAL_TOKENS[tk.SEP]
    framing = {name: {"id": name, "ids": [tk.SPECIAL_TOKENS.index(name)], "tokens": [name]} for name in (start, end)}
    whole = {
        "version": "1.0",
        "truncation": None if max_length is None else {"direction": "Right", "max_length": max_length, "strategy": "LongestFirst", "stride": 0},
        "padding": None,
        "added_tokens": [
            {"id": i, "content": name, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
            for i, name in enumerate(tk.SPECIAL_TOKENS)
        ],
        "normalizer": {
            "type": "Sequence",
            "normalizers": [
                *({"type": "Replace", "pattern": {"String": quotes}, "content": '"'} for quotes in ("``", "''")),
                {"type": "NFC"}, {"type": "Lowercase"},
            ],
        },
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "WhitespaceSplit"}, {"type": "Punctuation", "behavior": "Isolated"},
                {"type": "Digits", "individual_digits": False}, meta,
            ],
        },
        "post_processor": {
            "type": "TemplateProcessing",
            "single": frame((start, 0), ("A", 0), (end, 0)),
            "pair": frame((start, 0), ("A", 0), (end, 0), ("B", 1), (end, 1)),
            "special_tokens": framing,
        },
        "decoder": meta,
        "model": {"type": "Unigram", "unk_id": tk.UNK, "vocab": [list(p) for p in pieces], "byte_fallback": False}
        if model == "unigram"
        else {"type": "WordLevel", "vocab": {p: i for i, (p, _) in enumerate(pieces)}, "unk_token": unknown},
    }
    return json.dumps(whole, ensure_ascii=False)


def save_tokenizer(vocab: DataFrame, path: str, *, model="unigram", max_length: int | None = None) -> None:
    """Write ``tokenizer.json`` in a folder (or the named file); an older one is replaced."""
    spark = vocab.sparkSession
    text = tokenizer_text(vocab, model=model, max_length=max_length)
    file, store = _file(spark, path)
    out = store.create(file, True)
    try:
        data = text.encode()
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def named_by_size(folder: str, vocab_size: int) -> str:
    """Where a vocabulary of a size is kept under a folder."""
    return f"{folder.rstrip('/')}/{vocab_size:_}"
