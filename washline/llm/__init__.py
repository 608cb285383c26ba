"""Operators for building training corpora: filters, dedup, classifiers, mixing, WARC."""
