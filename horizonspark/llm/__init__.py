"""Training-data operators: scans, scoring, sharding, dedup, mixing, extraction."""
