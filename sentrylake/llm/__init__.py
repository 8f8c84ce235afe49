"""Training-data operators: mixing, packing, language-model scoring, archives, near-duplicates,
fingerprints, quality rules, quality classifier, secret scans and sharding."""
