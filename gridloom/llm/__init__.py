"""Operators for training-data pipelines: extraction, fingerprints, classifiers, dedup, tokens, packing."""
