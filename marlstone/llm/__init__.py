"""Training-data operators: classifiers, fingerprints, near-dedup, search, packing, redaction, mixing."""
