from datetime import date

import pytest
from conftest import at, rows

from casestats.plans import access, analysis, evolution, indicators
from casestats.plans.marts import lifetime_first_quartile

AS_OF = "2001-08-01 12:00:00"


def lifetimes(*groups):
    """(org, unit, type, [days])"""
    counted = {}
    for org, unit, kind, days in groups:
        for n in days:
            key = (org, unit, kind, n)
            counted[key] = counted.get(key, 0) + 1
    return [(*k, v) for k, v in counted.items()]


@pytest.fixture
def lived(marts):
    return marts(
        lifetime_counts=lifetimes(
            ("A", "U", "x", [1, 2, 3, 10]), ("B", "U", "x", [40, 41]), ("A", "V", "y", [2])
        ),
        lifetime_median_by_type=[("x", 6.5), ("y", 2.0)],
        lifetime_first_quartile=[(2.0,)],
    )


def test_median_lifetime(lived):
    assert rows(indicators.median_lifetime(lived)) == [(3.0,)]
    assert rows(indicators.median_lifetime(lived, "A")) == [(2.0,)]
    assert rows(indicators.median_lifetime(lived, "A", "U")) == [(2.5,)]
    assert rows(indicators.median_lifetime(lived, "nobody")) == [(None,)]


def test_lifetime_by_type(lived):
    assert rows(indicators.lifetime_by_type(lived)) == [("x", 6.5), ("y", 2.0)]
    assert rows(lifetime_first_quartile(lived)) == rows(lived["lifetime_first_quartile"])
    assert rows(indicators.lifetime_by_type(lived, "A")) == [
        ("x", 2.5, "Dentro do esperado"),
        ("y", 2.0, "Dentro do esperado"),
    ]
    assert rows(indicators.lifetime_by_type(lived, "B")) == [("x", 40.5, "Atrasado  34  dias")]
    assert rows(indicators.lifetime_by_type(lived, "nobody")) == []


def test_boxes(marts):
    few, many = ("A", "U", "x", [1, 2, 3, 10]), ("A", "U", "y", [5] * 9 + [50])
    m = marts(lifetime_counts=lifetimes(few, many))
    x, y = analysis.lifetime_boxes(m).collect()
    assert (x.q1, x.mediana, x.q3) == (1.75, 2.5, 4.75)
    assert (x.minimo, x.maximo, x.haste_inferior, x.haste_superior) == (1, 10, 1, 3)
    assert (x.processos, x.discrepantes) == (4, 1)
    assert (y.q1, y.q3, y.haste_inferior, y.haste_superior, y.discrepantes) == (5, 5, 5, 5, 1)


def test_assignees(marts):
    def waiting(who, days, org="A", kind="x", n=1):
        return (org, "U", kind, who, days, n)

    m = marts(
        days_in_unit_counts=[
            waiting("ana", 1), waiting("ana", 4), waiting(None, 9), waiting(" ", 8),
            waiting("bia", 30, org="B", n=3),
        ],
        days_in_unit_median_by_type=[("x", 9.0)],
        lifetime_first_quartile=[(3.0,)],
    )
    # The blank assignee is dropped with a selection only.
    assert rows(indicators.assignee_time(m)) == [
        ("bia", "x", 30.0), (" ", "x", 8.0), ("ana", "x", 2.5),
    ]
    assert rows(indicators.assignee_time(m, "A")) == [("ana", "x", 2.5, "Adiantado")]
    assert rows(indicators.assignee_time(m, "B", "U")) == [
        ("bia", "x", 30.0, "Atrasado  21  dias")
    ]
    totals = marts(days_in_unit_totals=[("A", "U", "x", 1, 3), ("B", "U", "x", 1, 4)])
    assert rows(indicators.open_process_count(totals)) == [(7,)]
    assert rows(indicators.open_process_count(totals, "A")) == [(3,)]


def test_top_types(marts):
    m = marts(
        process_types_by_org_unit=[("A", "U", "x", 3), ("B", "U", "x", 3), ("A", "V", "y", 2)]
    )
    assert rows(indicators.top_process_types(m)) == [("x", 6, 0.75), ("y", 2, 0.25)]
    # One unit name in two orgs is one slice.
    assert rows(indicators.top_process_types(m, "Todos", "U")) == [("x", 6, 1.0)]


@pytest.mark.parametrize("sums, total", [([0.5], 0.0), ([1.5], 2.0), ([1.25, 1.25], 2.0)])
def test_pages_round_half_to_even(marts, sums, total):
    m = marts(pages_saved=[("A", f"U{i}", s) for i, s in enumerate(sums)])
    assert rows(indicators.pages_saved_total(m)) == [(total,)]


def test_weekly_evolution_is_in_order_of_time(marts):
    def week(day, label, n, org="A"):
        return (org, "U", 2001, 1, day, day, label, n)

    m = marts(weekly_filings=[
        week(date(2001, 7, 22), "22-28/Jul", 1), week(date(2001, 5, 20), "20-26/May", 2),
        week(date(2001, 5, 20), "20-26/May", 3, org="B"),
    ])
    assert rows(indicators.weekly_evolution(m)) == [("20-26/May", 5), ("22-28/Jul", 1)]


@pytest.fixture
def grants(access_tables):
    return access_tables(
        auth=[
            ("one", 1, at("2001-07-31 00:01")), ("late", 1, at("2001-07-31 00:00")),
            ("two", 2, at("2001-08-01")), ("all", 3, at("2001-08-01")),
            ("none", 4, at("2001-08-01")),
        ],
        permissao=[(1, 1), (2, 2), (2, 1), (3, 1), (3, 9)],
        acesso_orgao=[(1, "A"), (2, "B"), (9, "*")],
    )


@pytest.mark.parametrize(
    "token, orgs, left",
    [
        ("one", ["A"], ["A"]),
        ("two", ["A", "B"], ["A", "B"]),
        ("all", ["Todos", "A", "C"], ["A", "B", None]),
        ("late", [], []),
        ("none", [], []),
        ("unknown", [], []),
    ],
)
def test_access(marts, frame, grants, token, orgs, left):
    active = marts(active_orgs=[("A",), ("C",)])["active_orgs"]
    allowed = access.authorized_orgs(grants, active, token, AS_OF)
    assert [r[0] for r in rows(allowed)] == orgs
    df = frame("orgao STRING, n INT", [("A", 1), ("B", 2), (None, 3)])
    got = access.restrict_to_orgs(df, allowed)
    assert got.columns == df.columns
    assert [r[0] for r in sorted(rows(got), key=lambda r: r[1])] == left


def test_rankings(marts, frame):
    def week(org, n):
        return (org, "U", 2001, 1, date(2001, 7, 22), date(2001, 7, 28), "", n)

    m = marts(
        weekly_history=[week("A", 4), week("A", 2), week("B", 6), week("C", 3), week("D", 7)],
        monthly_filings=[("A", 2001, 7, "7/2001", 20), ("B", 2001, 7, "7/2001", 29),
                         ("A", 2001, 6, "6/2001", 900)],
    )
    paper = frame(
        "orgao STRING, data DATE, papel BIGINT",
        [("A", date(2001, 7, 22), 2), ("A", date(2001, 7, 28), 1), ("A", date(2001, 7, 29), 50),
         ("B", date(2001, 7, 25), 3), ("C", date(2001, 7, 25), 1), ("E", date(2001, 7, 25), 5)],
    )
    assert rows(evolution.migration_ranking_weekly(m, paper, AS_OF)) == [
        ("D", 7, 0, None, 1), ("A", 6, 3, 2.0, 2), ("B", 6, 3, 2.0, 2), ("E", 0, 5, 0.0, 4),
    ]
    assert rows(evolution.migration_ranking_monthly(m, paper, AS_OF)) == [
        ("B", 29, 3, 29 / 3, 1), ("A", 20, 53, 20 / 53, 2),
    ]


def test_project_evolution(marts):
    m = marts(monthly_filings=[
        ("A", 2015, 12, "12/2015", 1), ("A", 2016, 1, "1/2016", 2), ("B", 2016, 1, "1/2016", 3),
        ("A", 2017, 2, "2/2017", 4),
    ])
    assert rows(evolution.project_monthly(m)) == [
        (2016, 1, "1/2016", 5), (2017, 2, "2/2017", 4),
    ]
