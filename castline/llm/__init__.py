"""Training-data operators: search, decontamination, dedup, scoring, mixing, sharding."""
