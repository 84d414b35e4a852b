"""Operators of a training-data pipeline: filters, dedup, mixing, formatting and counts.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
