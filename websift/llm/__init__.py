"""Operators for large training-data pipelines (sharding, packing, near-duplicates, PII, mixing, WARC, ...)."""
