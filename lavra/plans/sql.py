"""Fragments of the checking SQL (DuckDB). They state the rules plainly, not the way the jobs run."""

from __future__ import annotations

from lavra.functions.stopwords import STOPWORDS
from lavra.functions.text import PRE_TOKEN, WS
from lavra.functions.tokens import VOCABULARY_SIZE

NL = "chr(10)"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda w: w <> '')"


def fold(text: str) -> str:
    return f"replace(replace(replace(lower({text}), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')"


def trim(text: str) -> str:
    return rf"regexp_replace({text}, '\A{WS}|{WS}\z', '', 'g')"


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP_CASE = (
    "CASE lang "
    + " ".join(f"WHEN '{k}' THEN {text_list(v)}" for k, v in STOPWORDS.items())
    + f" ELSE {text_list(sorted({w for values in STOPWORDS.values() for w in values}))} END"
)

_MEASURES = f"""
SELECT *, len(words)::BIGINT AS num_words,
       len(list_filter({words(fold('text'))}, lambda w: list_contains({STOP_CASE}, w)))::BIGINT AS stopwords,
       list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / len(words) AS average
"""

# Measured documents (>= 100 words) and paragraphs (>= 2 words).
DOC_MEASURES = f"""
doc_words AS (SELECT doc_id, lang, text, {words('text')} AS words FROM documents),
measured AS ({_MEASURES} FROM doc_words WHERE len(words) >= 100)
"""
LINES = f"""
parts AS (SELECT doc_id, lang, string_split(text, {NL}) AS parts FROM documents),
raw_lines AS (
  SELECT doc_id, lang, unnest(range(len(parts)))::INT AS para_idx, unnest(parts) AS line FROM parts
),
lines AS (SELECT doc_id, lang, para_idx, {trim('line')} AS text FROM raw_lines)
"""
PARA_MEASURES = f"""
{LINES},
para_words AS (SELECT *, {words('text')} AS words FROM lines),
measured AS ({_MEASURES} FROM para_words WHERE len(words) >= 2)
"""


def normal(text: str) -> str:
    return f"lower(nfc_normalize(replace(replace({text}, '``', '\"'), '''''', '\"')))"


def pre(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all({normal(text)}, '{PRE_TOKEN}', 0), "
        "lambda p: CASE WHEN starts_with(p, '▁') THEN p ELSE '▁' || p END)"
    )


PRE = f"pre AS (SELECT doc_id, {pre('text')} AS toks FROM documents)"


def vocab(size: int = VOCABULARY_SIZE) -> str:
    """Word-level vocabulary: most frequent first, ids from 5."""
    return f"""
    word_counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(toks) AS word FROM pre) GROUP BY word),
    vocab AS (
      SELECT word AS piece, (row_number() OVER (ORDER BY n DESC, word) + 4)::INT AS id, n FROM word_counts
      QUALIFY id < {size}
    )
    """


def encoded(source: str = "pre", key: str = "doc_id", toks: str = "toks", name: str = "enc") -> str:
    """Ids of each row's tokens, [UNK] = 1, in order; rows without tokens keep an empty list."""
    return f"""
    {name}_tok AS (
      SELECT {key}, unnest({toks}) AS tok, unnest(range(len({toks}))) AS pos FROM {source}
    ),
    {name}_ids AS (
      SELECT {key}, list(coalesce(id, 1) ORDER BY pos) AS ids
      FROM {name}_tok LEFT JOIN vocab ON tok = piece GROUP BY {key}
    ),
    {name} AS (
      SELECT s.{key}, coalesce(ids, []::INT[]) AS ids FROM {source} s LEFT JOIN {name}_ids USING ({key})
    )
    """


ENC = f"{PRE}, {vocab()}, {encoded()}"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
