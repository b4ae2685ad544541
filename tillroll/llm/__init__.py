"""Training-data operators: dedup, PII, quality, packing, sharding, language."""
