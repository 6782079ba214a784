"""Decoding of the text cells of rule lists and suite sheets."""

from __future__ import annotations

import ast
import json
import re
from decimal import Decimal

_RANGE = re.compile(r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$")


def as_list(value, raw: bool = False) -> list[str]:
    """A list cell: a real list, JSON, a Python literal, or one (quoted) scalar.

    ``raw`` takes the items between quotes as they stand, so that backslashes of regular expressions survive.
    """
    if isinstance(value, (list, tuple, set)):
        return [str(v) for v in value]
    text = str(value).strip()
    for decode in (json.loads,) if raw else (json.loads, ast.literal_eval):
        try:
            decoded = decode(text)
        except (ValueError, SyntaxError):
            continue
        if isinstance(decoded, (list, tuple, set)):
            return [str(v) for v in decoded]
        return [str(decoded)]
    if text.startswith("[") and text.endswith("]"):
        return [_unquote(part) for part in re.findall(r"'(?:[^']*)'|\"(?:[^\"]*)\"", text)]
    return [_unquote(text)]


def as_scalar(value) -> str:
    """A scalar cell without one surrounding pair of quotes."""
    return _unquote(str(value).strip())


def as_range(value) -> tuple[Decimal, Decimal]:
    """``lo-hi`` with inclusive, possibly negative bounds."""
    match = _RANGE.match(str(value))
    if not match:
        raise ValueError(f"not a range of two numbers: {value!r}")
    return Decimal(match.group(1)), Decimal(match.group(2))


def predicate(text: str | None) -> str | None:
    """A free-text row filter; blank means none, a leading WHERE or AND is dropped."""
    body = re.sub(r"^\s*(?:where|and)\b", "", str(text or ""), flags=re.IGNORECASE).strip().rstrip(";").strip()
    return body or None


def names(text) -> list[str]:
    """A comma-separated list of names, trimmed, blanks dropped."""
    if isinstance(text, (list, tuple)):
        return [str(n).strip() for n in text if str(n).strip()]
    return [n.strip() for n in str(text or "").split(",") if n.strip()]


def _unquote(text: str) -> str:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text
