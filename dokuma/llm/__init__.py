"""Training-data operators: sharding, packing, vector search, secrets, deduplication, tokens, classifiers."""
