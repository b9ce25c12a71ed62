"""Operators of a training-data pipeline: URL and quality filters, line, near
and exact dedup, WARC bundles, tokenisers, token files, mixing, chat logs."""
