"""Quality rules over measured rows, and row filters over token tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lavra.functions.tokens import bad_row


@dataclass(frozen=True)
class QualityRule:
    """Inclusive limits on word count, stop words and mean word length."""

    min_words: int
    max_words: int | None
    min_stopwords: int
    min_average: float
    max_average: float
    words_exclusive: bool = False

    def condition(self) -> Column:
        words = F.col("num_words")
        test = words >= self.min_words
        if self.max_words is not None:
            test &= words < self.max_words if self.words_exclusive else words <= self.max_words
        return (
            test
            & (F.col("stopwords") >= self.min_stopwords)
            & F.col("average").between(self.min_average, self.max_average)
        )


# The limits of the four rules in use.
RULES = {
    "phase1": QualityRule(20, 1024, 2, 2.0, 15.0),
    "phase2": QualityRule(100, None, 2, 2.0, 15.0),
    "early": QualityRule(20, 512, 1, 2.0, 15.0),
    "short": QualityRule(10, 20, 2, 3.0, 10.0, words_exclusive=True),
}


def apply_rule(measured: DataFrame, rule: QualityRule | str) -> DataFrame:
    rule = RULES[rule] if isinstance(rule, str) else rule
    return measured.where(rule.condition())


def drop_bad_token_rows(tokenized: DataFrame, ids: str = "input_ids", probe: int = 10) -> DataFrame:
    """Keep padded rows that were not cut off and that reach past the probed position."""
    return tokenized.where(~bad_row(ids, probe))
