"""Training-data operators: deduplication, mixing, packing, scoring and filters."""
