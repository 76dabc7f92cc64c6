"""Training-data operators: packing, dedup, search, scans, quality, mixing and sharding."""
