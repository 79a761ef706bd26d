"""Operators for preparing training text: scoring, scanning, sharding, formatting, deduplication,
decontamination, vector search and tokenization. Nothing else in the package imports this one."""
