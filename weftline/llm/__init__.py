"""Training-data operators: packing, search, decontamination, classifiers and deduplication."""
