"""Operators for building training corpora: media, tokens, language, quality, packing, near-duplicates.

Nothing outside this subpackage imports it.
"""
