"""Sets of processes, roll-ups, units by name and paging by key: results and plans."""

import contextlib
import io
from itertools import product
from random import Random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casestats import fixed_values as fixed
from casestats.operators import filters
from casestats.operators.paging import next_cursor, numbered, table_page, table_page_after
from casestats.plans import evolution, indicators, stock
from casestats.plans import marts as plans
from casestats.sinks import marts as store
from casestats.sources.schemas import MARTS, schema_of
from casestats.sources.staging import stage


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


def control(spark, held):
    """Rows (org, unit, type, number, assignee, days) as the mart of open processes."""
    ddl = (
        "orgao_atual STRING, unidade_atual STRING, tipo_processo STRING, num_processo STRING, "
        "atribuido STRING, dias_unidade BIGINT"
    )
    df = spark.createDataFrame(held, ddl)
    schema = schema_of(MARTS["open_process_control"])
    return df.select(
        *[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )


def held_rows(seed, n):
    """A third of all in one place; numbers that are open in several places or repeat."""
    rng = Random(seed)
    out = []
    for _ in range(n):
        hot = rng.random() < 1 / 3
        place = ("A", "U1", "t") if hot else (
            rng.choice(["A", "B", None]), rng.choice(["U1", "U10", "U2", None, "A.B"]), rng.choice("tuv"),
        )
        number = None if rng.random() < 0.05 else f"P{rng.randrange(n // 2)}"
        out.append((*place, number, rng.choice([None, "ana", "bia"]), rng.randrange(5)))
    return out


def derived(spark, held):
    m = {"open_process_control": control(spark, held)}
    m["assignee_days"] = plans.assignee_days(m)
    m["open_process_summary"] = plans.open_process_summary(m)
    for name in ("open_activity_rollup", "days_in_unit_counts", "days_in_unit_totals",
                 "open_process_bitmaps", "current_unit_options"):
        mart = getattr(plans, name)(m)
        m[name] = stage(mart, name) if name in plans.SHARED else mart
    return m


@pytest.mark.parametrize("together", [3, 20_000])
def test_processes_count_once(spark, monkeypatch, together):
    monkeypatch.setattr(fixed, "NUMBERED_TOGETHER", together)
    held = held_rows(1, 600)
    m = derived(spark, held)
    scopes = product(["Todos", "A"], ["Todas", "U1", "A.B"], ["Todos", "t"], [False, True])
    for org, unit, kind, sub in [*scopes, ("nobody", "U1", "t", False)]:
        got = rows(stock.stock_distinct_total(m, org, unit, kind, subunits=sub))
        chosen = {
            p for o, u, t, p, *_ in held
            if p and org in ("Todos", o) and kind in ("Todos", t)
            and (unit == "Todas" or u == unit or sub and u and unit == "U1" and u.startswith("U1"))
        }
        assert got == [(len(chosen),)], (org, unit, kind, sub)


def test_a_number_is_one_bit(spark):
    m = derived(spark, held_rows(2, 400))
    sets = m["open_process_bitmaps"].collect()
    per_place = rows(
        m["open_process_control"].groupBy("orgao_atual", "unidade_atual", "tipo_processo")
        .agg(F.countDistinct("num_processo").alias("n")).filter("n > 0")
    )
    counted = {}
    for r in sets:
        place = tuple(r[:3])
        counted[place] = counted.get(place, 0) + sum(b.bit_count() for b in r.mapa)
    assert counted == {tuple(p[:3]): p[3] for p in per_place}


def test_more_processes_than_one_bucket_holds(spark):
    """Numbers stand without gaps, so 100,000 take four buckets and few rows."""
    spread = spark.range(100_000).selectExpr(
        "'A' AS orgao_atual", "concat('U', if(id % 3 = 0, 0, id % 7)) AS unidade_atual",
        "'t' AS tipo_processo", "concat('P', id % 90000) AS num_processo",
    )
    sets = plans.open_process_bitmaps({"open_process_control": spread})
    found = sets.groupBy("balde").agg(F.bitmap_count(F.bitmap_or_agg("mapa")).alias("n"))
    assert sorted(r.n for r in found.collect()) == [90_000 - 2 * 32_768, 32_768, 32_768]
    assert sets.count() <= 7 * 3
    text = plan(sets)
    for operator in ("CartesianProduct", "NestedLoop", "Python"):
        assert operator not in text


def test_no_open_process(spark):
    m = derived(spark, [])
    assert rows(stock.stock_distinct_total(m)) == [(0,)]
    assert rows(indicators.open_process_count(m)) == [(0,)]


def test_both_levels_of_the_rollup(spark):
    held = held_rows(3, 300)
    m = derived(spark, held)
    assert rows(indicators.open_process_count(m)) == [(len(held),)]
    for name in ("days_in_unit_counts", "days_in_unit_totals"):
        assert m[name].columns == schema_of(MARTS[name]).fieldNames()
        assert m[name].agg(F.sum("atividades")).first()[0] == len(held)
    assert m["days_in_unit_totals"].count() == len({(o, u, t, d) for o, u, t, _, _, d in held})
    assert m["days_in_unit_counts"].count() == len({(o, u, t, a, d) for o, u, t, _, a, d in held})
    medians = {r[0]: r[1] for r in rows(plans.days_in_unit_median_by_type(m))}
    for kind in "tuv":
        days = sorted(d for _, _, t, _, _, d in held if t == kind)
        middle = (days[(len(days) - 1) // 2] + days[len(days) // 2]) / 2
        assert medians[kind] == middle


def stored(spark, mart, name, folder):
    store._write(mart, name, f"{folder}/{name}")
    return store._read(spark, name, f"{folder}/{name}")


@pytest.fixture
def on_disk(spark, tmp_path):
    m = derived(spark, held_rows(4, 500))
    m["open_activity_rollup"] = stored(spark, m["open_activity_rollup"], "open_activity_rollup", tmp_path)
    m["days_in_unit_totals"] = plans.days_in_unit_totals(m)
    m["days_in_unit_counts"] = plans.days_in_unit_counts(m)
    m["open_process_bitmaps"] = stored(spark, m["open_process_bitmaps"], "open_process_bitmaps", tmp_path)
    m["current_unit_options"] = plans.current_unit_options(m)
    return m


def test_counts_open_the_level_and_the_org_they_need(on_disk):
    count = indicators.open_process_count(on_disk, "A")
    text = plan(count)
    told = text.split("PartitionFilters: [")[1].split("\n")[0]
    assert "nivel" in told and "pasta" in told
    assert "(nivel#" in told and "= 1)" in told and "atribuido" not in text


def test_the_distinct_total_reads_sets_alone(on_disk):
    total = stock.stock_distinct_total(on_disk, "A", "U1", "t")
    assert all("/open_process_bitmaps/" in f for f in total.inputFiles())
    assert "open_process_control" not in plan(total)


def test_sub_units_are_named_to_the_scan(on_disk):
    total = stock.stock_distinct_total(on_disk, "Todos", "U1", subunits=True)
    text = plan(total)
    assert "In(unidade_atual, [U1,U10])" in text and "RLIKE" not in text


def test_units_are_looked_up_once(spark):
    units = spark.createDataFrame([("A", "N_1"), ("B", "N_1"), ("A", "N_10"), ("A", "A/B(1)"), ("A", None)], "orgao STRING, unidade STRING")
    assert filters.units_matching(units, "unidade", "N_1") == ["N_1", "N_10"]
    assert filters.units_matching(units, "unidade", "B(1)", literal=True) == ["A/B(1)"]
    assert filters.units_matching(units, "unidade", "nothing") == []
    assert filters.units_matching(units, "unidade", "N", most=1) is None
    # Beyond the bound each row is tried.
    df = units.withColumn("tipo_processo", F.lit("t"))
    for bound in (10, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(filters.units_matching, "__defaults__", (False, bound))
            got = filters.scope(df, "A", "N_1", subunits=True, units=units)
            assert sorted(r.unidade for r in got.collect()) == ["N_1", "N_10"]
            assert ("RLIKE" in plan(got)) == (bound == 1)
    assert filters.scope(df, "A", "nothing", subunits=True, units=units).count() == 0


# Paging

ROW = st.tuples(
    st.sampled_from([None, "a", "A", "b", ""]), st.sampled_from([None, 1, 2, 3]),
    st.sampled_from([None, 0.5, -1.0, 2.0]),
)


@settings(max_examples=25, deadline=None)
@given(
    given_rows=st.lists(ROW, max_size=12),
    sort=st.permutations([("t", True), ("n", False), ("x", True), ("n", True), ("t", False)]),
    columns=st.integers(0, 2),
    length=st.integers(3, 7),
)
def test_pages_by_key_cover_the_table(spark, given_rows, sort, columns, length):
    """NULLs, ties and repeated rows, up and down: the pages in a row are the sorted table."""
    chosen, named = [], set()
    for name, up in sort:
        if name not in named and len(chosen) < columns:
            chosen.append((name, up))
            named.add(name)
    df = spark.createDataFrame(given_rows, "t STRING, n INT, x DOUBLE").coalesce(1)
    whole = rows(table_page(df, sort=chosen, length=100))
    seen, cursor = [], None
    for _ in range(len(given_rows) + 2):
        page = table_page_after(df, cursor, sort=chosen, length=length).collect()
        seen += [tuple(r) for r in page]
        cursor = next_cursor(page, cursor)
        if len(page) < length:
            break
    assert seen == whole and len(seen) == len(given_rows)


def test_a_page_by_key_searches_and_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id % 50 AS dia", "concat('P', id) AS p").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    sort, cursor = [("dia", False)], None
    for number in range(1, 5):
        page = table_page_after(df, cursor, search="p1", sort=sort)
        assert rows(page) == rows(table_page(df, search="p1", sort=sort, page=number))
        cursor = next_cursor(page.collect(), cursor)
    assert "LessThanOrEqual(dia" in plan(page)
    # The page after the last one is empty, and its cursor stays.
    end = table_page_after(df, None, sort=sort, length=2000).collect()
    cursor = next_cursor(end)
    assert rows(table_page_after(df, cursor, sort=sort)) == []
    assert next_cursor([], cursor) == cursor


def test_numbered(spark):
    df = spark.range(100, numPartitions=4).selectExpr("id * 37 % 101 AS x").orderBy(F.desc("x"))
    got = rows(numbered(df))
    assert [x for x, _ in sorted(got, key=lambda r: r[1])] == sorted((r[0] for r in got), reverse=True)


# Ranges and headers


def test_ranges_of_the_evolution(marts):
    from datetime import date, timedelta

    weeks = [date(2001, 1, 7) + timedelta(7 * k) for k in range(4)]
    m = marts(
        weekly_history=[("A", "U", w.year, 1, w, w + timedelta(6), "", 1) for w in weeks],
        monthly_filings=[("A", 2001, k, f"{k}/2001", k) for k in range(1, 13)],
    )
    starts = lambda *a: [r.inicio for r in evolution.project_weekly(m, *a).collect()]
    assert starts() == weeks
    assert starts("2001-01-16", "2001-01-21") == weeks[1:3]
    assert starts(None, "2001-01-20") == weeks[:2]
    months = lambda *a: [r.mes for r in evolution.project_monthly(m, *a).collect()]
    assert months("2001-03-31", "2001-05-01") == [3, 4, 5]
    assert months("2001-11-30") == [11, 12]


def test_screen_headers(marts):
    m = marts(
        lifetime_counts=[("A", "U", "x", 3, 1)], lifetime_median_by_type=[("x", 6.5)],
        lifetime_first_quartile=[(2.0,)], days_in_unit_median_by_type=[("x", 9.0)],
        days_in_unit_counts=[("A", "U", "x", "ana", 1, 1)],
    )
    shown = indicators.lifetime_by_type(m, "A", headers=True)
    assert shown.columns == ["Tipo de processo", "Tempo de vida mediano", "Diferença com a mediana geral"]
    assert indicators.lifetime_by_type(m, headers=True).columns == shown.columns[:2]
    shown = indicators.assignee_time(m, "A", headers=True)
    assert shown.columns == [
        "Usuário", "Tipo de processo", "Tempo mediano", "Diferença em relação ao tempo mediano",
    ]
    whole = indicators.assignee_time(m, headers=True)
    assert whole.columns == ["Usuário", "Tipo de processo", "Tempo de vida mediano"]
