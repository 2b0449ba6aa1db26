"""Training-data operators: deduplication, licence scans, mixing, language ID, decontamination, extraction, sharding."""
