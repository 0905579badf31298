"""Training-data operators: filters, deduplication, formatting, tokenisation."""
