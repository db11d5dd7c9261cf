"""Operators of a training-data pipeline: quality, toxicity, de-duplication,
subword encoding, secret scans, sharding, archives and source mixing."""
