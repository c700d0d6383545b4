"""Operators for preparing training text; ``queries`` registers one query for each and ``corpus_pipeline`` chains five."""
