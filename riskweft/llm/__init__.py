"""Operators for training-data pipelines: search, decontamination, near-duplicates, language and
quality models, tokenisation and text extraction.  Nothing outside this package imports it."""
