"""Training-data operators: language, privacy, tokens, urls, leaks, shards, duplicates, media, packing, toxicity."""
