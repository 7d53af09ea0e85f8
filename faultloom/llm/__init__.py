"""Training-data operators: near-duplicate joins, mixing, packing, crawl records, quality, language, extraction, chat."""
