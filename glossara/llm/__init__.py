"""Training-data operators: sharding, deduplication, quality, mixing, packing and formatting."""
