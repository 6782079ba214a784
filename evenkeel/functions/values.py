"""Scalar expressions shared by the operators. All of them stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def col(name: str) -> Column:
    """A column by its literal name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(left: Column, right: Column, abs_tol: float = 0, rel_tol: float = 0) -> Column:
    """NULL-safe equality; with a tolerance, ``|l - r| <= abs_tol + rel_tol * |r|`` for numbers."""
    equal = left.eqNullSafe(right)
    if not abs_tol and not rel_tol:
        return equal
    near = F.abs(left - right) <= F.lit(abs_tol) + F.lit(rel_tol) * F.abs(right)
    return equal | F.coalesce(near, F.lit(False))


def key_text(keys: Sequence[str], value=col) -> Column:
    """Key rendering of the reports: ``k1=v1, k2= v2``; a NULL key part reads ``NULL``."""
    parts = []
    for i, key in enumerate(keys):
        parts.append(F.lit(f"{key}=" if i == 0 else f", {key}= "))
        parts.append(F.coalesce(value(key).cast("string"), F.lit("NULL")))
    return F.concat(*parts)


def blank_to(value: Column, default: Column | str) -> Column:
    """The value, or ``default`` where it is NULL or blank."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.trim(value) != "", value).otherwise(fallback)


def debit_credit(amount: Column) -> Column:
    """``C`` for a negative amount, ``D`` otherwise."""
    return F.when(amount < 0, "C").otherwise("D")


def full_name(*parts: Column) -> Column:
    """Name parts joined by single blanks, a NULL part reads as empty text."""
    filled = [F.coalesce(p, F.lit("")) for p in parts]
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), filled)


def date_text_ok(value: Column) -> Column:
    """Whether text is eight digits and a calendar day in ``yyyyMMdd``."""
    eight = value.rlike("^[0-9]{8}$")
    return F.coalesce(eight & F.try_to_date(value, "yyyyMMdd").isNotNull(), F.lit(False))


def two_decimals(value: Column) -> Column:
    """Whether text is a signed number with exactly two decimals."""
    return F.coalesce(value.rlike(r"^-?[0-9]+\.[0-9]{2}$"), F.lit(False))


def text_mask(value: Column) -> Column:
    """Text pattern: every letter becomes ``A``, every digit ``9``, the rest stays."""
    return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]", "A"), "[0-9]", "9")
