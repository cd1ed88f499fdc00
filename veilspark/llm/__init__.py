"""Training-data operators: HTML, token files, toxicity, packing, BPE, shards, media, quality, chat and Jaccard joins."""
