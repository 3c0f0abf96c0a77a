"""Training-data operators: deduplication, scoring, mixing, formatting, cleaning."""
