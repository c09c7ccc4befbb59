"""Operators for preparing training text: filtering, scanning, scoring, deduplication and tokenizing of documents.

Nothing outside this package imports it.
"""
