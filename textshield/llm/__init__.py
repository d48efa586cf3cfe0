"""Training-data operators: formatting, filtering, deduplication, sharding, packing, archives, tokens."""
