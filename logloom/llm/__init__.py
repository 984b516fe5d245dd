"""Training-data operators: cleaning, deduplication, filtering, mixing and packing."""
