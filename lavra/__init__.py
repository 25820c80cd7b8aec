"""lavra: Spark jobs that turn raw text corpora into model-ready token tables."""
