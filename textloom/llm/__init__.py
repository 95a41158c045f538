"""Training-data operators: deduplication, quality, mixing, packing, safety."""
