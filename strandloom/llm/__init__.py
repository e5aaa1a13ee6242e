"""Training-data operators: packing, deduplication, tokenising, filtering, scoring."""
