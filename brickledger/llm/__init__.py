"""Training-data operators: formatting, sharding, scrubbing, deduplication, tokenising, extraction."""
