"""Scores by task name, each a function from predictions to one or more score rows."""

from __future__ import annotations

from lavra.operators.scores import (
    classification_scores,
    entity_scores,
    perplexity,
    regression_scores,
)

METRICS = {
    "mlm": perplexity,
    "ner": entity_scores,
    "rte": classification_scores,
    "sts": regression_scores,
}


def evaluate(task: str, predictions, **options):
    """Score a prediction table for one of the tasks; an unknown task raises."""
    return METRICS[task](predictions, **options)
