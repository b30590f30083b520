"""Training-data operators: secrets, extraction, deduplication, filters and mixing."""
