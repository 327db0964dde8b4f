"""Training-data operators: mixing, decontamination, media, quality, secrets, chat, near-dedup, WARC, toxicity, HTML."""
