from collections import defaultdict
from datetime import date, timedelta
from random import Random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from casestats.operators.filters import scope
from casestats.operators.paging import table_page
from casestats.plans import stock


def d(n):
    return date(2001, 1, 1) + timedelta(days=n)


def move(n, direction, qtde=1, org="A", unit="U", kind="t"):
    return (org, unit, kind, direction, d(n), qtde)


def balance(marts, moves, start, end, *selection, **options):
    m = marts(stock_daily=moves)
    return rows(stock.stock_balance(m, *selection, start=d(start), end=d(end), **options))


def test_only_exits_before_the_period(marts):
    moves = [move(0, "Saída"), move(1, "Saída"), move(10, "Entrada")]
    assert balance(marts, moves, 5, 20) == [(d(10), -1, -1)]


def test_nothing_in_the_period(marts):
    assert balance(marts, [move(0, "Entrada")], 5, 20) == []
    assert balance(marts, [], 5, 20) == []


def test_days_without_movement_are_absent(marts):
    moves = [move(0, "Entrada", 5), move(6, "Saída", 2), move(9, "Entrada", 4)]
    assert balance(marts, moves, 6, 9) == [(d(6), 3, 3), (d(9), 4, 7)]


def test_both_ends_belong_to_the_period(marts):
    moves = [move(n, "Entrada") for n in (4, 5, 9, 10)]
    assert balance(marts, moves, 5, 9) == [(d(5), 2, 2), (d(9), 1, 3)]


def test_opening_balance_has_the_same_scope(marts):
    moves = [
        move(0, "Entrada", 5, org="A"),
        move(0, "Entrada", 7, org="B"),
        move(6, "Entrada", 1, org="A"),
    ]
    assert balance(marts, moves, 5, 9, "A") == [(d(6), 6, 6)]


def test_balance_by_unit(marts):
    moves = [
        move(0, "Entrada", 5, unit="U"),
        move(6, "Saída", 1, unit="U"),
        move(7, "Entrada", 2, unit="V"),
        move(8, "Saída", 1, unit="U"),
    ]
    assert balance(marts, moves, 5, 9, by=["unidade"]) == [
        ("U", d(6), 4, 4), ("U", d(8), -1, 3), ("V", d(7), 2, 2),
    ]


def test_chart(marts):
    m = marts(stock_daily=[move(0, "Entrada", 5), move(6, "Saída", 2), move(7, "Entrada", 3)])
    assert rows(stock.stock_chart(m, start=d(5), end=d(9))) == [
        (d(6), None, 2, 3),
        (d(7), 3, None, 6),
    ]


movement = st.tuples(
    st.integers(0, 30), st.sampled_from(["Entrada", "Saída"]), st.integers(1, 9),
    st.sampled_from(["A", "B"]), st.sampled_from(["N_1", "N_10", "N_2"]),
    st.sampled_from(["t", "u"]),
)


@settings(max_examples=25, deadline=None)
@given(st.lists(movement, max_size=60), st.integers(0, 30), st.integers(0, 30))
def test_balance_properties(spark, moves, a, b):
    from casestats.sources.schemas import MARTS

    start, end = sorted((a, b))
    moves = [move(*m) for m in moves]
    m = {"stock_daily": spark.createDataFrame(moves, MARTS["stock_daily"])}
    period = {"start": d(start), "end": d(end)}

    def signed(up_to):
        return sum(q if x == "Entrada" else -q for *_, x, day, q in moves if day <= up_to)

    series = rows(stock.stock_balance(m, **period))
    assert [s[0] for s in series] == sorted(
        {day for *_, day, _ in moves if d(start) <= day <= d(end)}
    )
    assert [s[2] for s in series] == [signed(s[0]) for s in series]
    assert sum(s[1] for s in series) == (signed(d(end)) if series else 0)

    # Sub-units hold the unit; units add up to the whole.
    exact = scope(m["stock_daily"], unidade="N_1")
    wider = scope(m["stock_daily"], unidade="N_1", subunits=True)
    assert exact.exceptAll(wider).isEmpty()
    whole, parts = defaultdict(int), defaultdict(int)
    for day, x, q in rows(stock.stock_flow(m, **period)):
        whole[day, x] += q
    for unit in ("N_1", "N_10", "N_2"):
        for day, x, q in rows(stock.stock_flow(m, "Todos", unit, **period)):
            parts[day, x] += q
    assert whole == parts


NAMES = ["A.B", "AxB", "A/B(1)", "A/B1", "a.b"]


@pytest.mark.parametrize(
    "selection, options, found",
    [
        ("A.B", {}, ["A.B"]),
        ("A.B", {"subunits": True}, ["A.B", "AxB", "A/B(1)", "A/B1"]),
        ("A.B", {"subunits": True, "literal": True}, ["A.B"]),
        ("A/B(1)", {}, ["A/B(1)"]),
        ("A/B(1)", {"subunits": True}, ["A/B1"]),
        ("A/B(1)", {"subunits": True, "literal": True}, ["A/B(1)"]),
        ("Todas", {"subunits": True}, NAMES),
    ],
)
def test_sub_units(frame, selection, options, found):
    df = frame("orgao STRING, unidade STRING", [("O", n) for n in NAMES] + [("O", None)])
    got = [r[1] for r in rows(scope(df, "Todos", selection, **options))]
    assert [n for n in got if n] == found


def test_null_is_no_match(frame):
    df = frame("orgao STRING, unidade STRING", [(None, "U"), ("O", None), ("O", "U")])
    assert rows(scope(df, "O")) == [("O", None), ("O", "U")]
    assert rows(scope(df, "O", "U")) == [("O", "U")]
    assert scope(df).count() == 3


def test_options(marts):
    m = marts(
        stock_units=[("B", "U"), ("A", "U"), ("A", "*"), ("A", "B")],
        stock_daily=[move(0, "Entrada", kind="y"), move(0, "Saída", kind="x")],
    )
    assert rows(stock.stock_unit_options(m)) == [("Todas",), ("B",), ("U",), ("U",)]
    assert rows(stock.stock_unit_options(m, "A")) == [("Todas",), ("B",), ("U",)]
    assert rows(stock.type_options(m)) == [("Todos",), ("x",), ("y",)]


def test_default_period(frame):
    df = frame("as_of STRING", [("2024-02-29 10:00:00",)]).selectExpr(
        "CAST(as_of AS TIMESTAMP) AS as_of"
    )
    assert rows(stock.default_period(df)) == [(date(2024, 2, 1), date(2024, 2, 29))]


def test_export_of_an_org_unit_with_sub_units(marts):
    m = marts(stock_movements=[
        ("A", "N_1", "t", "Entrada", d(1), 1, 1),
        ("A", "N_10", "t", "Entrada", d(2), 1, 1),
        ("B", "N_1", "t", "Entrada", d(2), 1, 1),
        ("A", "N_1", "t", "Entrada", d(30), 1, 1),
    ])
    got = stock.stock_export(m, "A", "N_1", start=d(0), end=d(9), subunits=True)
    assert sorted(r[1] for r in rows(got)) == ["N_1", "N_10"]


def summary(n, org="A", unit="U", kind="t", who=None):
    return (f"P{n:03}", "1/1/2001", kind, None, unit, n % 7, who, d(0), org)


def test_table_and_headers(marts):
    m = marts(open_process_summary=[summary(1), summary(2, org="B"), summary(3, kind="u")])
    assert stock.open_process_table(m).count() == 3
    table = stock.open_process_table(m, "A", "U", "t", headers=True)
    assert table.columns == [
        "Processo", "Data", "Tipo de Processo", "Nível de Acesso", "Unidade Atual",
        "Dias na unidade", "Atribuído para",
    ]
    assert [r[0] for r in rows(table)] == ["P001"]


def test_pages_cover_every_row_once(marts):
    rng = Random(3)
    given_rows = [summary(n, who=rng.choice([None, "Ana", "bia"])) for n in range(47)]
    rng.shuffle(given_rows)
    table = stock.open_process_table(marts(open_process_summary=given_rows))
    pages = [
        rows(table_page(table, sort=[("dias_unidade", False)], page=p)) for p in range(1, 7)
    ]
    assert [len(p) for p in pages] == [10, 10, 10, 10, 7, 0]
    seen = [r for p in pages for r in p]
    assert len(set(seen)) == 47
    assert [r[5] for r in seen] == sorted((r[5] for r in seen), reverse=True)
    found = rows(table_page(table, search="ANA", length=100))
    assert {r[6] for r in found} == {"Ana"}
    assert len(found) == sum(r[6] == "Ana" for r in given_rows)
    assert len(rows(table_page(table, search="p01", length=100))) == 10
