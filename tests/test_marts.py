"""Marts against hand-made cases, and against a plain Python reading of the definitions."""

from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from random import Random
from statistics import median

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from casestats.plans.marts import LazyMarts, weekly_filings
from casestats.plans import indicators, stock

AS_OF = "2001-08-01 12:00:00"
ORGS = [(1, "A", "S"), (2, "B", "N")]
UNITS = [(10, 1, "A.X"), (11, 1, "A.Y"), (20, 2, "B.X")]
USERS = [(1, 1, "ana", "S"), (2, 1, "bia", "N"), (3, 2, "caio", "S")]
TYPES = [(1, "compra"), (2, "licença")]


def process(i, created, unit=10, kind="P", level=0, user=1):
    return (i, f"P{i}", kind, at(created), unit, user, level, f"d{i}")


def activity(i, p, opened, closed=None, unit=10, task=1, user=None):
    return (i, p, unit, task, at(opened), at(closed) if closed else None, user)


@pytest.fixture
def lazy(case_tables):
    def make(as_of=AS_OF, **given):
        base = {
            "orgao": ORGS,
            "unidade": UNITS,
            "usuario": USERS,
            "tipo_procedimento": TYPES,
        }
        return LazyMarts(case_tables(**{**base, **given}), as_of)

    return make


def headers(protocolo, kind=1):
    return [(p[0], kind) for p in protocolo]


def test_only_this_list_asks_whether_an_org_is_active(lazy):
    m = lazy(protocolo=[process(1, "2001-01-01", unit=20)])
    assert rows(m["active_orgs"]) == [("A",)]
    assert rows(m["processes_by_org_unit"]) == [("B", "B.X", 1)]


def test_users(lazy):
    m = lazy()
    assert sorted(rows(m["active_users_by_org"])) == [("A", 1), ("B", 1)]
    assert rows(indicators.registered_users(m)) == [(2,)]
    assert rows(indicators.registered_users(m, "A", "any unit")) == [(1,)]
    assert rows(indicators.registered_users(m, "nobody")) == [(0,)]


def test_a_process_without_header_is_counted_once_and_dropped_elsewhere(lazy):
    p = [process(1, "2001-07-20"), process(2, "2001-07-20")]
    m = lazy(protocolo=p, procedimento=[(1, 1)], atividade=[
        activity(1, 1, "2001-07-20"), activity(2, 2, "2001-07-20"),
    ])
    assert rows(m["processes_by_org_unit"]) == [("A", "A.X", 2)]
    assert rows(m["process_types_by_org_unit"]) == [("A", "A.X", "compra", 1)]
    assert rows(m["monthly_filings"]) == [("A", 2001, 7, "7/2001", 1)]
    assert rows(m["weekly_filings"].select("total")) == [(1,)]
    assert m["process_lifetime"].count() == 1
    assert m["stock_movements"].count() == 1
    assert m["open_process_control"].count() == 1


def test_types_of_items_that_are_no_processes_count_as_used(lazy):
    m = lazy(
        protocolo=[process(1, "2001-01-01"), process(2, "2001-01-01", kind="G")],
        procedimento=[(1, 1), (2, 2), (3, 1)],
    )
    assert rows(m["distinct_process_types"]) == [(2,)]


def test_two_type_ids_of_one_name_merge(lazy):
    p = [process(1, "2001-01-01"), process(2, "2001-01-01")]
    m = lazy(
        protocolo=p,
        procedimento=[(1, 1), (2, 2)],
        tipo_procedimento=[(1, "compra"), (2, "compra")],
    )
    assert rows(m["distinct_process_types"]) == [(1,)]
    assert rows(m["process_types_by_org_unit"]) == [("A", "A.X", "compra", 2)]


def test_two_units_of_one_name_merge(lazy):
    p = [process(1, "2001-07-01", unit=10), process(2, "2001-07-01", unit=11)]
    m = lazy(
        unidade=[(10, 1, "A.X"), (11, 1, "A.X")],
        protocolo=p,
        procedimento=headers(p),
        anexo=[(10, 1024), (11, 1024)],
    )
    assert rows(m["processes_by_org_unit"]) == [("A", "A.X", 2)]
    assert rows(m["external_pages"]) == [("A", "A.X", 2 / 335)]


def test_week_over_new_year_is_one_week(lazy):
    p = [process(1, "1999-12-30"), process(2, "2000-01-01")]
    m = lazy("2000-01-12 08:00:00", protocolo=p, procedimento=headers(p))
    assert rows(m["weekly_filings"]) == [
        ("A", "A.X", 1999, 52, date(1999, 12, 26), date(2000, 1, 1), "26/Dec-01/Jan", 2)
    ]


def test_year_that_starts_on_a_sunday(lazy):
    p = [process(1, "2017-01-01"), process(2, "2017-01-07")]
    m = lazy("2017-01-20", protocolo=p, procedimento=headers(p))
    assert rows(m["weekly_filings"]) == [
        ("A", "A.X", 2017, 1, date(2017, 1, 1), date(2017, 1, 7), "01-07/Jan", 2)
    ]


def test_ten_complete_weeks(lazy):
    # 2001-08-01 is a Wednesday: the weeks run from 2001-05-20 to 2001-07-28.
    days = ["2001-05-19 23:59", "2001-05-20 00:00", "2001-07-28 23:59", "2001-07-29 00:00"]
    p = [process(i, d) for i, d in enumerate(days)]
    m = lazy(protocolo=p, procedimento=headers(p))
    starts = [r[0] for r in rows(m["weekly_filings"].select("inicio").orderBy("inicio"))]
    assert starts == [date(2001, 5, 20), date(2001, 7, 22)]
    everything = weekly_filings(m.tables, AS_OF, weeks=None)
    assert everything.agg(F.sum("total")).first()[0] == 3


def test_lifetime_follows_the_greatest_activity_id(lazy):
    p = [process(i, "2001-07-01") for i in (1, 2, 3, 4)]
    m = lazy(protocolo=p, procedimento=headers(p), atividade=[
        # latest open, earlier closed: lives until now
        activity(10, 1, "2001-07-01", "2001-07-05"), activity(11, 1, "2001-07-05"),
        # latest closed, earlier open: until that conclusion
        activity(20, 2, "2001-07-01"), activity(21, 2, "2001-07-02", "2001-07-11"),
        # greatest id concluded first
        activity(30, 3, "2001-07-01", "2001-07-21"), activity(31, 3, "2001-07-02", "2001-07-04"),
    ])
    assert sorted(r[3] for r in rows(m["process_lifetime"])) == [3, 10, 31]


def test_control_has_a_row_per_open_activity(lazy):
    p = [process(1, "2001-07-02", level=3, user=2)]
    m = lazy(protocolo=p, procedimento=headers(p), atividade=[
        activity(1, 1, "2001-07-02 23:59", unit=10, user=3),
        activity(2, 1, "2001-07-31", unit=20, user=99),
        activity(3, 1, "2001-08-01", unit=77),
        activity(4, 1, "2001-07-02", "2001-07-03", unit=11),
    ])
    got = {(r.unidade_atual, r.orgao_atual): r for r in m["open_process_control"].collect()}
    assert set(got) == {("A.X", "A"), ("B.X", "B"), (None, None)}
    r = got["A.X", "A"]
    assert (r.orgao, r.unidade, r.num_processo, r.usuario) == ("A", "A.X", "P1", "bia")
    assert (r.ano, r.mes, r.dia, r.data, r.data_filtro) == (
        2001, 7, 2, "2/7/2001", date(2001, 7, 2),
    )
    assert r.nivel_acesso is None
    assert (r.dias_unidade, r.tempo_vida, r.atribuido) == (30, 30, "caio")
    assert [got[k].atribuido for k in (("B.X", "B"), (None, None))] == [None, None]
    assert rows(indicators.open_process_count(m)) == [(3,)]
    assert rows(stock.stock_distinct_total(m)) == [(1,)]
    assert rows(indicators.open_process_count(m, "B")) == [(1,)]
    assert m["current_unit_options"].count() == 3
    assert rows(indicators.unit_options(m)) == [("Todas",), ("A.X",), ("B.X",)]


@pytest.mark.parametrize("level, name", [(0, "Público"), (1, "Restrito"), (2, "Sigiloso")])
def test_access_levels(lazy, level, name):
    p = [process(1, "2001-07-02", level=level)]
    m = lazy(
        protocolo=p, procedimento=headers(p), atividade=[activity(1, 1, "2001-07-02")]
    )
    assert m["open_process_control"].first().nivel_acesso == name


def test_a_process_whose_creator_is_unknown_is_not_controlled(lazy):
    p = [process(1, "2001-07-02", user=99)]
    m = lazy(
        protocolo=p, procedimento=headers(p), atividade=[activity(1, 1, "2001-07-02")]
    )
    assert m["open_process_control"].count() == 0
    assert m["stock_movements"].count() == 1


def test_movements_of_closed_processes_are_left_out(lazy):
    p = [process(1, "2001-07-02"), process(2, "2001-07-02")]
    m = lazy(protocolo=p, procedimento=headers(p), atividade=[
        activity(1, 1, "2001-07-02 10:00", task=1),
        activity(2, 1, "2001-07-02 11:00", "2001-07-03", task=32),
        activity(3, 1, "2001-07-03", "2001-07-03", task=28, unit=11),
        activity(4, 1, "2001-07-03", "2001-07-03", task=99),
        activity(5, 2, "2001-07-02", "2001-07-03", task=1),
    ])
    assert sorted(rows(m["stock_movements"])) == [
        ("A", "A.X", "compra", "Entrada", date(2001, 7, 2), 1, 2),
        ("A", "A.Y", "compra", "Saída", date(2001, 7, 3), 1, 1),
    ]
    assert sorted(rows(m["stock_units"])) == [("A", "A.X"), ("A", "A.Y")]


def test_pages(lazy):
    m = lazy(
        anexo=[(10, 1024 * 335), (10, 1024 * 335), (20, 5)],
        documento=[(1, 10, "I"), (2, 10, "X"), (3, 11, "I")],
        documento_conteudo=[(1, "é" * (512 * 75)), (2, "x"), (3, "x")],
    )
    # Two bytes per letter: 1024 * 75 bytes are two pages of 37.5 KB.
    assert sorted(rows(m["internal_pages"])) == [("A", "A.X", 2.0), ("A", "A.Y", 1 / 1024 / 37.5)]
    assert rows(m["pages_saved"]) == [("A", "A.X", 4.0)]
    assert rows(indicators.pages_saved_total(m)) == [(4.0,)]
    assert rows(indicators.pages_saved_total(m, "B")) == [(0.0,)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(lazy, seed):
    """Random tables, with one process, one unit and one user holding a third of the rows."""
    rng = Random(seed)

    def hot(choices, first):
        return first if rng.random() < 1 / 3 else rng.choice(choices)

    day0 = datetime(2001, 1, 1)

    def when():
        return day0 + timedelta(minutes=rng.randrange(200 * 24 * 60))

    protocols = [
        (i, f"P{i}", rng.choice("PPPG"), when(), hot([10, 11, 20, 77], 10),
         hot([1, 2, 3, 99], 1), rng.randrange(4), f"d{i}")
        for i in range(60)
    ]
    protocols[0] = (*protocols[0][:2], "P", *protocols[0][3:])
    head = [(i, rng.choice([1, 2, 9])) for i in range(60) if rng.random() < 0.9 or i == 0]
    head[0] = (0, 1)
    acts = [
        (i, hot(range(65), 0), hot([10, 11, 20, 77], 10), rng.choice([1, 28, 29, 32, 41, 99]),
         opened := when(),
         opened + timedelta(days=rng.randrange(40)) if rng.random() < 0.7 else None,
         rng.choice([None, 1, 2, 3, 99]))
        for i in range(600)
    ]
    m = lazy(protocolo=protocols, procedimento=head, atividade=acts)

    now = datetime.fromisoformat(AS_OF)
    org = {o[0]: o[1] for o in ORGS}
    unit = {u[0]: (org[u[1]], u[2]) for u in UNITS}
    kind, user, header = dict(TYPES), {u[0]: u[2] for u in USERS}, dict(head)
    processes = {
        p[0]: (p, kind[header[p[0]]])
        for p in protocols
        if p[2] == "P" and header.get(p[0]) in kind
    }
    by_process = defaultdict(list)
    for a in acts:
        by_process[a[1]].append(a)

    def days(a, b):
        return (b.date() - a.date()).days

    lifetimes = Counter(
        (*unit[p[4]], t, days(p[3], max(by_process[i])[5] or now))
        for i, (p, t) in processes.items()
        if p[4] in unit and by_process[i]
    )
    assert Counter(rows(m["process_lifetime"])) == lifetimes

    opened = {i for i in processes if any(a[5] is None for a in by_process[i])}
    moves = Counter(
        (*unit[a[2]], processes[a[1]][1], "Entrada" if a[3] in (1, 29, 32) else "Saída",
         a[4].date(), a[1])
        for a in acts
        if a[1] in opened and a[3] != 99 and a[2] in unit
    )
    assert {r[:-1]: r[-1] for r in rows(m["stock_movements"])} == moves

    control = Counter()
    for a in acts:
        if a[5] is not None or a[1] not in processes:
            continue
        p, t = processes[a[1]]
        if p[4] in unit and p[5] in user:
            here = unit.get(a[2], (None, None))
            control[(p[1], t, *here, days(a[4], now), days(p[3], now), user.get(a[6]))] += 1
    assert control == Counter(
        rows(
            m["open_process_control"].select(
                "num_processo", "tipo_processo", "orgao_atual", "unidade_atual",
                "dias_unidade", "tempo_vida", "atribuido",
            )
        )
    )

    by_type = defaultdict(list)
    for (_, _, t, n), count in lifetimes.items():
        by_type[t] += [n] * count
    assert dict(rows(m["lifetime_median_by_type"])) == {
        t: float(median(v)) for t, v in by_type.items()
    }
    waiting = defaultdict(list)
    for (_, t, _, _, n, _, _), count in control.items():
        waiting[t] += [n] * count
    assert dict(rows(m["days_in_unit_median_by_type"])) == {
        t: float(median(v)) for t, v in waiting.items()
    }
    # The result does not depend on how the input is partitioned.
    for name in ("atividade", "protocolo"):
        m.tables[name] = m.tables[name].repartition(7)
    again = LazyMarts(type(m.tables)(dict(m.tables)), AS_OF)
    assert Counter(rows(again["process_lifetime"])) == lifetimes
    assert {r[:-1]: r[-1] for r in rows(again["stock_movements"])} == moves
