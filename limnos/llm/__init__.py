"""Operators for large text corpora: media columns, language, fingerprints, duplicates, scoring, encoding, mixing."""
