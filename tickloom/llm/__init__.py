"""Operators for training-data pipelines: filtering, near-duplicates, decontamination, tokens, archives, shards."""
