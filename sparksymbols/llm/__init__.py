"""Operators on training data: archives, duplicates, licences, contamination, mixing, token counts, classifiers."""
