"""Training-data operators: toxicity, tokens, near and exact duplicates, quality, WARC derivatives and mixing."""
