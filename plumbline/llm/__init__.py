"""Training-data pipeline operators: dedup, counting, mixing, scoring, packing, search and storage of token ids."""
