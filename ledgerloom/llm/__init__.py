"""Training-data operators: decontamination, deduplication, personal data, mixing, sharding, quality, scoring."""
