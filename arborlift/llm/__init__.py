"""Operators for large text corpora, and their registered queries."""
