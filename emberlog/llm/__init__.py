"""Training-data operators: packing, near-duplicate joins, filters, search, scans, sharding."""
