"""Operators for preparing training text: mixing, PII, token counts, search, dedup, WARC, toxicity and BPE."""
