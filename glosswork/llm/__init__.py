"""Training-data operators: token counts, quality, packing, deduplication, scoring."""
