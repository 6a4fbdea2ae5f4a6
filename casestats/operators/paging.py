"""Search, sort and page of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

PAGE_LENGTH = 10

Sort = Sequence[tuple[str, bool]]


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: its last row, and how many rows equal to it have been shown."""

    row: dict
    shown: int


def table_page(
    df: DataFrame,
    search: str = "",
    sort: Sort = (),
    page: int = 1,
    length: int = PAGE_LENGTH,
) -> DataFrame:
    """One page of the rows that contain `search` in any column, ignoring case.

    `sort` lists (column, ascending). The other columns follow as tie-breakers, so that
    pages neither overlap nor miss rows. Each task keeps its best `page * length` rows: for
    going far into a table, see `table_page_after`.
    """
    keys = sort_keys(df, sort)
    return searched(df, search).orderBy(*_ordered(keys)).offset((page - 1) * length).limit(length)


def table_page_after(
    df: DataFrame,
    cursor: Cursor | None,
    search: str = "",
    sort: Sort = (),
    length: int = PAGE_LENGTH,
) -> DataFrame:
    """The page that follows `cursor` (the first one for `None`), as `table_page` has it.

    Rows before the cursor are filtered out, at the scan where the first key can be pushed
    down, so each task keeps one page of rows however far the page is.
    """
    keys = sort_keys(df, sort)
    rows = searched(df, search)
    if cursor is None:
        return rows.orderBy(*_ordered(keys)).limit(length)
    rows = rows.filter(_reached(df, *keys[0], cursor.row)).filter(
        _not_before(df, keys, cursor.row)
    )
    return rows.orderBy(*_ordered(keys)).offset(cursor.shown).limit(length)


def next_cursor(page: Sequence[Row], cursor: Cursor | None = None) -> Cursor | None:
    """The cursor after a page that was collected; the old one after a page without rows."""
    if not page:
        return cursor
    last = page[-1].asDict()
    shown = sum(row.asDict() == last for row in page)
    if cursor and shown == len(page) and cursor.row == last:
        shown += cursor.shown
    return Cursor(last, shown)


def numbered(df: DataFrame) -> DataFrame:
    """A sorted result with the place of each row, from 1. For results of a screen's size."""
    within = df.withColumn("_lugar", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_lugar")).cast("bigint")
    return within.withColumn("posicao", place).drop("_lugar")


def searched(df: DataFrame, search: str) -> DataFrame:
    if not search:
        return df
    wanted = search.lower()
    hits = [F.lower(F.col(f"`{c}`").cast("string")).contains(wanted) for c in df.columns]
    return df.filter(reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]))


def sort_keys(df: DataFrame, sort: Sort) -> list[tuple[str, bool]]:
    """The chosen columns, then all others: equal keys mean equal rows."""
    named = [c for c, _ in sort]
    return [*sort, *((c, True) for c in df.columns if c not in named)]


def _ordered(keys: Sort) -> list[Column]:
    """NULL comes first upwards and last downwards."""
    return [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in keys]


def _reached(df: DataFrame, name: str, up: bool, row: dict) -> Column:
    """What the first key alone says, in a form that a scan understands."""
    column, value = F.col(f"`{name}`"), F.lit(row[name]).cast(df.schema[name].dataType)
    if row[name] is None:
        return F.lit(True) if up else column.isNull()
    return column >= value if up else (column <= value) | column.isNull()


def _not_before(df: DataFrame, keys: Sort, row: dict) -> Column:
    """Whether a row's keys are equal to or after those of `row`, compared from left to right."""
    found = F.lit(True)
    for name, up in reversed(keys):
        column, value = F.col(f"`{name}`"), F.lit(row[name]).cast(df.schema[name].dataType)
        if row[name] is None:
            after = column.isNotNull() if up else F.lit(False)
        else:
            after = column > value if up else (column < value) | column.isNull()
        found = after | (column.eqNullSafe(value) & found)
    return F.coalesce(found, F.lit(False))
