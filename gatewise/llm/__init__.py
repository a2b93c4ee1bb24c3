"""Training-data operators: sharding, counting, near duplicates, quality, search, packing, mixing and filters."""
