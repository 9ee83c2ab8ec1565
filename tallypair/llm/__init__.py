"""Training-data operators: deduplication, scoring, decontamination, counting, search and mixing."""
