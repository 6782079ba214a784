"""Column-level helpers: everything here returns ``Column`` objects or plain parsed values."""

from .parsing import as_list, as_range, predicate
from .values import (
    blank_to,
    date_text_ok,
    debit_credit,
    full_name,
    col,
    key_text,
    let,
    same,
    text_mask,
    two_decimals,
)

__all__ = [
    "as_list", "as_range", "blank_to", "col", "date_text_ok", "debit_credit", "full_name", "key_text", "let",
    "predicate", "same", "text_mask", "two_decimals",
]
