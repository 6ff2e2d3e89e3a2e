"""Operators of a training-data pipeline: cleaning, deduplication, tokenisation and archives."""
