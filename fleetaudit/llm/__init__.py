"""Operators for training-data pipelines: fingerprints, tokens, quality, duplicates, mixing, search, language, toxicity."""
