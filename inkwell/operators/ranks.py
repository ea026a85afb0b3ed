"""Ranks within groups that may be as large as a third of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spread_ranks(df: DataFrame, keys: list[str], order: Column, tie: str, out: str = "rank", slots: int = 256) -> DataFrame:
    """Add the 0-based rank of each row within its keys, by `order` (a 64-bit hash) and then by the column `tie`.

    The leading bits of the hash cut every group into `slots` ranges of about equal size. Ranges are counted
    first, and a row's rank is the size of the ranges before its own plus its place inside it, so no task sorts
    more than a slot of a group. Rows with a null key are left out.
    """
    bits = slots.bit_length() - 1
    h, s = "__order", "__slot"
    rows = df.dropna(subset=keys).withColumn(h, order.cast("long"))
    rows = rows.withColumn(s, (F.shiftright(h, 64 - bits) + (slots >> 1)).cast("int"))
    sizes = rows.groupBy(*keys, s).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, s, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*keys, s).orderBy(h, tie)) - 1
    placed = rows.withColumn("__place", place).join(starts, [*keys, s])
    return placed.withColumn(out, (F.col("__start") + F.col("__place")).cast("long")).drop(h, s, "__place", "__start")
