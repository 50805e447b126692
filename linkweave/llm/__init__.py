"""Operators for building training data: fingerprints, classifiers, deduplication, decontamination, mixing, formatting.

Nothing else in the library imports this subpackage.
"""
