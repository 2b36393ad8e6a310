"""Scalar expressions on text, languages, titles and punctuation."""
