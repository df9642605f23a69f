"""Training-data operators: deduplication, filters, scoring and packing over document tables."""
