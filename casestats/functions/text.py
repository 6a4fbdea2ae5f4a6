"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casestats.fixed_values import EARLY, EXPECTED, LATE


def _formatted(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def number_text(x: Column) -> Column:
    """`1.234.567`, `12,5`: dots between thousands, a comma before decimals."""
    return F.translate(_formatted(x, "#,##0.#########"), ",.", ".,")


def days_text(x: Column) -> Column:
    return F.concat(number_text(x), F.lit("  dias"))


def plain_number(x: Column) -> Column:
    """`5`, `5.5`: a whole number shows no decimals, a large one no exponent."""
    return _formatted(x, "0.###############")


def decimal_comma(x: Column) -> Column:
    """Every significant digit, no exponent: the smallest double has 324 decimals."""
    return F.translate(_formatted(x, "0." + "#" * 340), ".", ",")


def deviation_label(scoped: Column, overall: Column, first_quartile: Column) -> Column:
    """How a median in scope stands against the one of the whole administration."""
    gap = scoped - overall
    late = F.concat(F.lit(f"{LATE}  "), plain_number(F.abs(gap)), F.lit("  dias"))
    return (
        F.when(gap > 0, late)
        .when(scoped < first_quartile, F.lit(EARLY))
        .otherwise(F.lit(EXPECTED))
    )
