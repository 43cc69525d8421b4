"""Training-data operators: overlaps, linking, near-duplicates, splits, vectors, tokens, contamination, languages."""
