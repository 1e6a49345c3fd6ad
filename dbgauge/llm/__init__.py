"""Operators for training-data corpora: deduplication, fingerprints, scoring, chat, archives and mixing."""
