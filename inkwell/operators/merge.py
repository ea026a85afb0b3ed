"""Idempotent upserts: what a load would create, update, leave and prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import fingerprint


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in the given order; a tie is settled by the columns that follow in it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def merge_plan(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str], scope: list[str] | None = None) -> DataFrame:
    """keys and action: created, updated, unchanged, and pruned for stored keys the load no longer makes.

    Rows are compared by the fingerprint of `fields`, null-safely. Both sides have one row per key. With `scope`,
    only keys of a scope that the load processed are pruned; an empty load prunes nothing.
    """
    s = stored.select(*keys, fingerprint(fields).alias("__old"))
    i = incoming.select(*keys, fingerprint(fields).alias("__new"))
    both = s.join(i, keys, "full_outer")
    action = (
        F.when(F.col("__old").isNull(), "created")
        .when(F.col("__new").isNull(), "pruned")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged")
        .otherwise("updated")
    )
    plan = both.select(*keys, action.alias("action"))
    processed = incoming.select(*(scope or keys[:1])).distinct()
    gone = plan.where("action = 'pruned'").join(processed, scope or keys[:1], "left_semi")
    return plan.where("action <> 'pruned'").unionByName(gone)


def apply_merge(stored: DataFrame, incoming: DataFrame, keys: list[str], plan: DataFrame) -> DataFrame:
    """The stored table after the plan: new and changed rows from the load, the others as they were, pruned ones gone."""
    take = plan.where("action in ('created', 'updated')").select(*keys)
    leave = plan.where("action in ('updated', 'pruned')").select(*keys)
    return stored.join(leave, keys, "left_anti").unionByName(incoming.join(take, keys, "left_semi"))
