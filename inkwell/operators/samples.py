"""Bounded samples that no task and no driver has to choose from all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_cut(rows: int, total: int) -> int:
    """The value that a little more than `rows` of `total` 64-bit hashes are not above; of all hashes the largest where that is not below the total."""
    share = (1.1 * rows + 100) / max(1, total)
    return 2**63 - 1 if share >= 1 else int((2 * share - 1) * 2**63)


def hash_sample(df: DataFrame, order: Column, rows: int, total: int) -> DataFrame:
    """At most `rows` rows of a frame of about `total`, those with the smallest values of `order` (a 64-bit hash of the row).

    The cut is worked out from the total before anything is sorted, so that the scan lets through only a few rows more than
    are wanted, whatever the number of partitions. Repeated rows share a hash and come together.
    """
    return df.withColumn("__h", order).where(F.col("__h") <= F.lit(hash_cut(rows, total))).orderBy("__h").limit(rows).drop("__h")
