"""Training-data operators: tokenising, packing, deduplication, scoring, media."""
