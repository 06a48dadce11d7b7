"""Training-data operators: scanning, filtering, deduplication, formatting, packing and scoring of text."""
