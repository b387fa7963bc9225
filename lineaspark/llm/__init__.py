"""Training-data operators: search, tokens, formatting, deduplication, quality and mixing."""
