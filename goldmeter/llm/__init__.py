"""Training-data operators: media, language, neighbours, quality, LM scores, packing, near-duplicates, tokens, licences, shards."""
