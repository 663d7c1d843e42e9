"""Training-data operators: tokenizing, deduplication, extraction, packing, scoring,
search and formatting.  Nothing else in the library imports this subpackage."""
