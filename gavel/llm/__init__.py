"""Operators of a training-data pipeline: deduplication, language and toxicity
models, tokenizer encoding, mixing, fingerprints and token files."""
