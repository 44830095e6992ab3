"""Training-data operators: formatting, packing, fingerprints, near-duplicates, extraction, scans."""
