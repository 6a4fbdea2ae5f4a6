"""Selections by organisation, unit, process type and period."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casestats.fixed_values import ALL_ORGS, ALL_TYPES, ALL_UNITS, WILDCARD
from casestats.functions.dates import day


# Units that a selection names one by one.
MAX_NAMES = 10_000


def scope(
    df: DataFrame,
    orgao: str = ALL_ORGS,
    unidade: str = ALL_UNITS,
    tipo: str = ALL_TYPES,
    *,
    subunits: bool = False,
    literal: bool = False,
    units: DataFrame | None = None,
    org_col: str = "orgao",
    unit_col: str = "unidade",
    type_col: str = "tipo_processo",
) -> DataFrame:
    """Rows of the selection. Which org and unit is meant depends on the mart, hence
    the column arguments. `units` lists the units of `df`: sub-units are then looked up there
    once, and the rows are selected by name."""
    parts = []
    if orgao != ALL_ORGS:
        parts.append(F.col(org_col) == orgao)
    if unidade != ALL_UNITS:
        names = None
        if subunits and units is not None:
            names = units_matching(units, unit_col, unidade, literal)
        if names is not None:
            parts.append(F.col(unit_col).isin(names))
        elif subunits:
            parts.append(unit_with_subunits(unit_col, unidade, literal))
        else:
            parts.append(unit_exact(unit_col, unidade))
    if tipo != ALL_TYPES:
        parts.append(F.col(type_col) == tipo)
    return df.filter(reduce(and_, parts)) if parts else df


def scope_current(df: DataFrame, *selection, **options) -> DataFrame:
    """`scope` by where a process is now."""
    return scope(df, *selection, org_col="orgao_atual", unit_col="unidade_atual", **options)


def unit_exact(unit_col: str, unidade: str) -> Column:
    return F.col(unit_col) == unidade


def unit_with_subunits(unit_col: str, unidade: str, literal: bool = False) -> Column:
    """Units whose short name contains a match of the selection, a regular expression.

    `literal=True` looks for the selection itself, for names such as `A/B(1)`.
    """
    name = F.col(unit_col)
    return name.contains(unidade) if literal else name.rlike(unidade)


def units_matching(
    units: DataFrame, unit_col: str, unidade: str, literal: bool = False, most: int = MAX_NAMES
) -> list[str] | None:
    """Names of the units that match; `None` if there are more than `most`.

    The pattern is tried on each unit instead of each row, and a scan can skip row groups by
    names, which it can't by a pattern.
    """
    found = units.filter(unit_with_subunits(unit_col, unidade, literal)).select(unit_col)
    names = [r[0] for r in found.distinct().limit(most + 1).collect()]
    return sorted(names) if len(names) <= most else None


def between_dates(date_col: str, start, end) -> Column:
    return F.col(date_col).between(day(start), day(end))


def before_date(date_col: str, start) -> Column:
    return F.col(date_col) < day(start)


def assigned_only(assignee_col: str = "atribuido") -> Column:
    return F.col(assignee_col).isNotNull()


def named_assignee(assignee_col: str = "atribuido") -> Column:
    return assigned_only(assignee_col) & (F.col(assignee_col) != " ")


def drop_wildcard_unit(df: DataFrame, unit_col: str) -> DataFrame:
    return df.filter(F.col(unit_col) != WILDCARD)
