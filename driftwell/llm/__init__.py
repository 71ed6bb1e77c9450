"""Training-data operators: deduplication, language, privacy, contamination, quality, toxicity, scoring and mixing."""
