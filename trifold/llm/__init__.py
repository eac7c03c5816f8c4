"""Training-data operators: classification, sharding, sanitising, packing, decontamination and duplicates."""
