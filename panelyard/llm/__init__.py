"""Operators of a training-data pipeline: search, dedup, tokens, mixing, cleaning, scans."""
