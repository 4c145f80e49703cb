"""Training-data operators: dedup, counting, packing, mixing, formatting, archives, quality."""
