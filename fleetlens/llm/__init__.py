"""Operators over training text: deduplication, language, quality, scoring, packing, licences, chat."""
