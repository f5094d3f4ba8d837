"""Training-data operators: dedup, decontamination, packing, formatting, classifiers, search."""
