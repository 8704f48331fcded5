"""Training-data operators: splits, cutting, repair, deduplication, contamination, packing, mixing."""
