"""Operators of a training-data pipeline: decontamination, deduplication, filters, scoring, search and mixing."""
