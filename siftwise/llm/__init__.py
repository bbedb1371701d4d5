"""Training-data operators: packing, deduplication, search, scoring, sharding, mixing, storage."""
