"""Operators of a training-data pipeline: near-duplicate join, page extraction,
URL filters, vector search, line dedup, source mixing, quote linking, quality
rules, sequence packing and language identification.

Nothing else in the library imports this subpackage; its registered queries
are in ``erario.llm.queries``.
"""
