"""Training-data operators: search, deduplication, filters, token counts, sharding and mixing."""
