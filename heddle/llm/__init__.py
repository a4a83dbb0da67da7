"""Training-data operators: extraction, filtering, deduplication, mixing, encoding and sharding."""
