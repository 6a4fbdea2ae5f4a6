"""Which organisations a session may analyse."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestats.fixed_values import ALL_ORGS, WILDCARD
from casestats.functions.dates import day


def authorized_orgs(
    access: Mapping[str, DataFrame], active_orgs: DataFrame, token: str, as_of
) -> DataFrame:
    """Selector entries (`orgao`) for a token created since midnight of the day before.

    A wildcard grant gives "Todos" and every active org. Without a valid token there are
    no rows.
    """
    since = F.date_sub(day(as_of), 1).cast("timestamp")
    granted = (
        access["auth"]
        .filter((F.col("token") == token) & (F.col("created_at") > since))
        .select("id_user")
        .join(access["permissao"], "id_user")
        .join(access["acesso_orgao"].withColumnRenamed("id", "id_orgao"), "id_orgao")
        .select(F.col("sigla").alias("orgao"), F.lit(1).alias("ordem"))
    )
    spark = active_orgs.sparkSession
    everything = (
        spark.range(1)
        .select(F.lit(ALL_ORGS).alias("orgao"), F.lit(0).alias("ordem"))
        .unionByName(active_orgs.select(F.col("sigla").alias("orgao"), F.lit(1).alias("ordem")))
    )
    unlimited = _any_row(granted, WILDCARD)
    return (
        everything.filter(unlimited)
        .unionByName(granted.filter(~unlimited))
        .orderBy("ordem", "orgao")
        .select("orgao")
    )


def restrict_to_orgs(df: DataFrame, allowed: DataFrame, org_col: str = "orgao") -> DataFrame:
    """Rows of the allowed orgs; all rows if "Todos" is among the entries.

    The entries (one per org at most) come in as one subquery, so that a scan of files
    partitioned by org opens the allowed folders only. A NULL org needs "Todos".
    """
    entries = allowed.agg(F.collect_set("orgao").alias("entradas")).scalar()
    org = F.col(org_col)
    granted = F.array_contains(entries, org) | F.array_contains(entries, ALL_ORGS)
    return df.filter(F.coalesce(granted, F.lit(False)))


def _any_row(orgs: DataFrame, value: str):
    """Whether an org list holds `value`, as one subquery evaluated once."""
    found = F.coalesce(F.max(F.col("orgao") == value), F.lit(False))
    return orgs.agg(found.alias("found")).scalar()
