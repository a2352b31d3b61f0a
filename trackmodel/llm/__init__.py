"""Training-data operators: decontamination, sharding, PII, near-dedup, quality, packing, rules, chat, language, tokens."""
