"""Operators for building training corpora: archives, language, packing, dedup, formats."""
