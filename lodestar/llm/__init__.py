"""Training-data operators: packing, deduplication, decontamination, scoring, archives."""
