"""Model-row expressions over arrays of token ids. All narrow, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lavra.functions.text import META, _col

# Special tokens in id order, the label that losses and scores skip, and the two sizes.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD, UNK, CLS, SEP, MASK = range(5)
IGNORE = -100
VOCABULARY_SIZE = 32_768
CONTEXT_SIZE = 8_192
MASKING_RATE = 0.3


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _times(value, n) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), n.cast("int"))


def template_single(ids) -> Column:
    """``[CLS] A [SEP]``"""
    return F.concat(_ints(CLS), _col(ids), _ints(SEP))


def template_pair(first, second) -> Column:
    """``[CLS] A [SEP] B [SEP]``"""
    return F.concat(_ints(CLS), _col(first), _ints(SEP), _col(second), _ints(SEP))


def pair_types(first, second) -> Column:
    """0 over ``[CLS] A [SEP]``, 1 over ``B [SEP]``."""
    return F.concat(_times(0, F.size(_col(first)) + 2), _times(1, F.size(_col(second)) + 1))


def truncate(ids, max_length: int, specials: int = 2) -> Column:
    """Cut the tail so that the ids and their special tokens fit."""
    return F.slice(_col(ids), 1, max(max_length - specials, 0))


def truncated_pair_sizes(first, second, max_length: int, specials: int = 3) -> tuple[Column, Column]:
    """Kept length of each side when the longer side is cut first; on a tie the first side is the shorter.

    With budget b the shorter side keeps min(its length, b div 2) and the longer side the rest.
    """
    n, m = F.size(_col(first)), F.size(_col(second))
    budget = max(max_length - specials, 0)
    half = budget // 2
    short = F.least(F.when(n <= m, n).otherwise(m), F.lit(half))
    fits = n + m <= budget
    keep_n = F.when(fits, n).when(n <= m, short).otherwise(F.lit(budget) - short)
    keep_m = F.when(fits, m).when(n <= m, F.lit(budget) - short).otherwise(short)
    return keep_n, keep_m


def pad_right(values, max_length: int, fill: int = PAD) -> Column:
    values = _col(values)
    return F.concat(values, _times(fill, F.greatest(F.lit(max_length) - F.size(values), F.lit(0))))


def attention_mask(n_text, total=None) -> Column:
    """1 over the text and its two special tokens, 0 over the padding up to ``total``."""
    n = _col(n_text)
    real = _times(1, n + 2)
    return real if total is None else F.concat(real, _times(0, F.lit(total) - n - 2))


def special_tokens_mask(n_text, total=None) -> Column:
    """1 over special tokens and padding, 0 over text. Derived from positions, not from id values."""
    n = _col(n_text)
    tail = _ints(1) if total is None else _times(1, F.lit(total) - n - 1)
    return F.concat(_ints(1), _times(0, n), tail)


def strip_specials(ids) -> Column:
    return F.filter(_col(ids), lambda x: x >= len(SPECIAL_TOKENS))


def join_pieces(pieces) -> Column:
    """Pieces back to text: the meta symbol becomes a space and the leading one is dropped."""
    joined = F.replace(F.array_join(_col(pieces), ""), F.lit(META), F.lit(" "))
    return F.regexp_replace(joined, r"\A ", "")


def align_labels(word_ids, word_labels) -> Column:
    """Label of each token: the word's on its first piece, else the ignored label.

    ``word_ids`` is null on special tokens and padding.
    """
    words, labels = _col(word_ids), _col(word_labels)

    def label(word, at):
        earlier = F.get(words, at - 1)
        return F.when(word.isNull() | word.eqNullSafe(earlier), F.lit(IGNORE)).otherwise(
            F.get(labels, word)
        )

    return F.transform(words, label)


def argmax(scores) -> Column:
    """Index of the largest score; the first one wins."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda, Spark would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(scores) -> Column:
    """Shares of the scores. Work grows with their number."""
    scores = _col(scores)

    def shares(powers):
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return _once(total, lambda t: F.transform(powers, lambda x: x / t))

    powers = _once(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return _once(powers, shares)


def bad_row(ids, probe: int = 10) -> Column:
    """Padded rows to drop: cut off (last id is real), or too short (padding already at ``probe``)."""
    ids = _col(ids)
    usable = (F.try_element_at(ids, F.lit(-1)) == PAD) & (F.get(ids, F.lit(probe)) != PAD)
    return ~F.coalesce(usable, F.lit(False))
