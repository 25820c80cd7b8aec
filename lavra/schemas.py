"""Declared schemas of the tables the library reads and writes."""

RAW_DOCS = "doc_id LONG, text STRING, lang STRING, source STRING"
NESTED_DOCS = "doc_id LONG, text STRUCT<paragraphs: ARRAY<ARRAY<STRING>>>"
VOCAB = "id INT, piece STRING, score DOUBLE, is_special BOOLEAN"
TOKENIZED = (
    "doc_id LONG, input_ids ARRAY<INT>, token_type_ids ARRAY<INT>, "
    "attention_mask ARRAY<INT>, special_tokens_mask ARRAY<INT>, split STRING"
)
TAGGED_WORDS = "id STRING, tokens ARRAY<STRING>, ner_tags ARRAY<INT>, split STRING"
PAIRS = (
    "sentence_pair_id LONG, premise STRING, hypothesis STRING, "
    "relatedness_score DOUBLE, entailment_judgment INT, split STRING"
)
METRIC_LOG = "run_id STRING, run_ts TIMESTAMP, tag STRING, step LONG, value DOUBLE"
METRIC_CSV = "Step LONG, Value DOUBLE"
