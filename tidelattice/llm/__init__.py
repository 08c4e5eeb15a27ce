"""Training-data operators: sharding, packing, filtering, extraction, deduplication, scoring."""
