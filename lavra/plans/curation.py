"""From raw sources to a tokenized table, stage by stage, each stage stored and used again."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lavra.functions.tokens import CONTEXT_SIZE, VOCABULARY_SIZE
from lavra.operators.cuts import key_columns, train_test_split
from lavra.operators.encoding import encode_documents, model_rows
from lavra.operators.filters import apply_rule
from lavra.operators.measures import measure_documents
from lavra.operators.unigram import train_unigram
from lavra.operators.vocabulary import load_vocabulary, save_vocabulary, word_vocabulary
from lavra.session import stage
from lavra.sources.corpora import union_sources
from lavra.sources.storage import identity, materialize, reusable, write_parameters


def curated_split(
    docs: DataFrame, *, key="doc_id", rule="phase2", test_size=0.1, seed=42, min_words=100
) -> DataFrame:
    """Measure, filter, drop the measures, split. The key is one column or several and must be unique.

    The keys of the kept documents are stored first, so that finding the cut reads no text again.
    """
    names = key_columns(key)
    good = apply_rule(measure_documents(docs, min_words=min_words), rule)
    keys = stage(good.select(*names), "kept-keys")
    return train_test_split(good.select(*names, "text"), key=key, test_size=test_size, seed=seed, keys=keys)


def curate(
    spark: SparkSession, sources: list[DataFrame], path: str, *, key="doc_id", rebuild=False, **options
) -> DataFrame:
    """The split corpus under ``path``, built from the sources unless it is there.

    Sources that number their rows on their own need a key of ``("source", "doc_id")``. A stored corpus made
    of other sources, or of files that have changed since, raises; without sources it is used as it is.
    """
    def build():
        docs = union_sources(sources, (*key_columns(key), "text", "lang"))
        return curated_split(docs, key=key, **options)

    parameters = {"key": key, **options, "sources": [identity(s) for s in sources]}
    return materialize(spark, build, path, parameters=parameters, rebuild=rebuild, ignore=() if sources else ("sources",))


def vocabulary(
    corpus: DataFrame, path: str, *, size=VOCABULARY_SIZE, model="unigram", rebuild=False, **options
) -> DataFrame:
    """The vocabulary under ``path``, trained on the train split unless it is there. One of another corpus raises."""
    spark = corpus.sparkSession
    parameters = {"size": size, "model": model, **options, "corpus": identity(corpus)}
    if not rebuild and reusable(spark, path, parameters):
        return load_vocabulary(spark, path)
    train = corpus.where("split = 'train'") if "split" in corpus.columns else corpus
    build = partial(train_unigram, **options) if model == "unigram" else word_vocabulary
    stored = save_vocabulary(build(train, size=size), path)
    write_parameters(spark, path, parameters)
    return stored


def tokenize(
    corpus: DataFrame, vocab: DataFrame, path: str, *, model="unigram",
    max_length=CONTEXT_SIZE, pad=False, rebuild=False, made_from: dict | None = None,
) -> DataFrame:
    """Model rows of every split under ``path``; those of another corpus or vocabulary raise.

    ``made_from`` may name what else they were made with.
    """
    def build():
        coded = encode_documents(corpus, vocab, model=model)
        return model_rows(coded, max_length=max_length, pad=pad)

    parameters = {"model": model, "max_length": max_length, "pad": pad, "made_from": made_from}
    parameters |= {"corpus": identity(corpus), "vocabulary": identity(vocab)}
    return materialize(corpus.sparkSession, build, path, parameters=parameters, rebuild=rebuild)


def raw_to_rows(
    spark: SparkSession, sources: list[DataFrame], folder: str, *, size=VOCABULARY_SIZE,
    model="unigram", key="doc_id", rebuild=False,
) -> DataFrame:
    """The whole flow; each stage is a table under ``folder``."""
    corpus = curate(spark, sources, f"{folder}/corpus", key=key, rebuild=rebuild)
    vocab = vocabulary(corpus, f"{folder}/vocabulary", size=size, model=model, rebuild=rebuild)
    made_from = {"size": size, "key": key}
    return tokenize(corpus, vocab, f"{folder}/tokenized", model=model, rebuild=rebuild, made_from=made_from)
