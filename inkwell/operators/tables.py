"""Small table operations: optional predicates, look-ups against a catalogue, value maps, backfills and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the values given; a None asks for nothing, a list for any of its values, an empty list for none."""
    for column, value in wanted.items():
        if value is None:
            continue
        many = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
        df = df.where(F.col(f"`{column}`").isin(*many)) if many else df.where(F.lit(False))
    return df


def has_any(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with the boolean column `name`: whether other has a row with the same keys (a null key matches nothing)."""
    there = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(there, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def remapped(value: Column, names: dict[str, str]) -> Column:
    """A value under its new name; values that the map doesn't name, and nulls, stay."""
    if not names:
        return value
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def backfilled(df: DataFrame, observed: DataFrame, keys: list[str], column: str) -> DataFrame:
    """df with `column` taken from observed where that has a value that differs (null-safely), and `changed`, whether it was."""
    new = observed.select(*keys, F.col(column).alias("__new")).where("__new is not null").dropDuplicates(keys)
    rows = df.join(new, keys, "left")
    differs = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))
    rows = rows.withColumn("changed", differs).withColumn(column, F.when(differs, F.col("__new")).otherwise(F.col(column)))
    return rows.select(*df.columns, "changed")


def catalogue_mismatches(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """source_document_id, problem: documents with a checksum that the catalogue hasn't, or has with other pages or another route.

    documents: source_document_id, sha256, page_count, ingestion_route; catalogue: sha256, pages, verdict (of several entries
    of a checksum the first by pages and verdict). Unknown pages or routes on either side are no mismatch, but a page count that
    the catalogue lacks is. One row for each problem.
    """
    first = catalogue.where("sha256 is not null").groupBy("sha256").agg(F.min(F.struct("pages", "verdict")).alias("c"))
    rows = documents.where("sha256 is not null").join(first, "sha256", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("c").isNull(), "not_in_catalogue"),
            F.when(F.col("c").isNotNull() & F.col("page_count").isNotNull() & ~F.col("c.pages").eqNullSafe(F.col("page_count")), "other_pages"),
            F.when(F.col("c.verdict").isNotNull() & ~F.col("c.verdict").eqNullSafe(F.col("ingestion_route")), "other_route"),
        )
    )
    return rows.select("source_document_id", F.explode(problems).alias("problem"))


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Add the rows of a run to a table of runs under a path; the rows carry the run's name, so that a run can be read alone."""
    df.withColumn("run", F.lit(run)).write.mode("append").parquet(path)
