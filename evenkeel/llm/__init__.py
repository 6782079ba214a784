"""Operators for training data. Nothing else in the library imports this subpackage."""

from . import (
    decontaminate, fingerprint, html_text, language_id, lexical, licenses, line_dedup, manifest, near_dedup, packing, preference,
    token_counts, url_filter,
)
from .common import ORACLE, QUERIES

__all__ = [
    "ORACLE", "QUERIES", "decontaminate", "fingerprint", "html_text", "language_id", "lexical", "licenses", "line_dedup", "manifest", "near_dedup", "packing",
    "preference", "token_counts", "url_filter",
]
