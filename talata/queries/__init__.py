"""Queries of the library's operators over the test tables, with their SQL."""

from . import corpus, files, generated, morph, rest, scores, surface, text, training, vocab  # noqa: F401
