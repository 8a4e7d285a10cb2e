"""Normalising raw product codes into candidates, in order of priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(raw: Column) -> Column:
    """The ASCII digits of a raw code; null gives ''."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")


def pad13(code: Column) -> Column:
    """Zeros in front up to 13 characters; longer codes stay whole, which lpad alone would cut."""
    return F.when(F.length(code) < 13, F.lpad(code, 13, "0")).otherwise(code)


def candidates(raw: Column) -> Column:
    """The distinct codes to look up, first one first; at most two.

    A code of 14 digits is a trade unit that wraps a code of 13, with or without its leading digit: what
    stands for fewer digits comes first only if the leading digit is zero.
    """
    d = digits(raw)
    inner = F.substr(d, F.lit(2))
    return (
        F.when(d == "", F.array().cast("array<string>"))
        .when((F.length(d) == 14) & d.startswith("0"), F.array(inner, d))
        .when(F.length(d) == 14, F.array(d, inner))
        .otherwise(F.array(pad13(d)))
    )
