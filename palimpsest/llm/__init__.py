"""Training-data operators: dedup, mixing, sharding, packing, quality, licenses, chat."""
