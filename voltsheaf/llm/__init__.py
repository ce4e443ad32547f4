"""Training-data operators: dedup, fingerprints, packing, secrets, language ID, HTML and WARC."""
