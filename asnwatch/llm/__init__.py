"""Operators for large text corpora: licences, quality, language, toxicity,
near duplicates, tokenisation, packing, language-model scoring and vector search.

Nothing outside this subpackage imports it.
"""
