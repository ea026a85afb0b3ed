"""Joins on order and on intervals, which Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], *, span: int = 0) -> DataFrame:
    """Each left row with `values` of the last right row of the same `by` whose `on` isn't later.

    Both sides are put in one sequence per key and the last right row is carried forward, so there is one shuffle
    and no pair is formed. A right row counts for left rows at the same position; of right rows at one position the
    greatest values win. Left rows with nothing before them get nulls; rows with a null in `by` or `on` match nothing.

    span > 0 cuts a long sequence at every span of `on` (a number): the carry then runs inside a slice, and what
    enters a slice is the last row of the slices before it, of which there is one per slice.
    """
    struct = F.struct(*[F.col(v) for v in values])
    a = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType))
    ok = F.col(on).isNotNull()
    for c in by:
        ok = ok & F.col(c).isNotNull()
    b = right.where(ok).select(*by, on, F.lit(0).alias("__side"), struct.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    extra: list[str] = []
    if span:
        both = both.withColumn("__slice", F.floor(F.col(on) / span).cast("long"))
        extra = ["__slice"]
    order = [F.col(on), F.col("__side"), F.col("__v")]
    w = Window.partitionBy(*by, *extra).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    if span:
        ends = b.withColumn("__slice", F.floor(F.col(on) / span).cast("long"))
        ends = ends.groupBy(*by, "__slice").agg(F.max(F.struct(F.col(on), F.col("__v"))).alias("__e"))
        w2 = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        seen = both.select(*by, "__slice").distinct().join(ends, [*by, "__slice"], "left")
        before = seen.select(*by, "__slice", F.last("__e", ignorenulls=True).over(w2).alias("__b"))
        carried = carried.join(before, [*by, "__slice"], "left").withColumn("__last", F.coalesce("__last", F.col("__b.__v")))
    out = carried.where("__side = 1")
    keep = [c for c in left.columns]
    return out.select(*keep, *[F.when(ok, F.col("__last")[v]).alias(v) for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], point: str, lo: str, hi: str, *, width: int) -> DataFrame:
    """Points inside intervals (lo <= point <= hi, both numbers) of the same key.

    An interval is entered in every bin of `width` it touches and a point in its own, so the join is an equi-join
    on key and bin. Choose a width near the usual length of an interval. Null keys or bounds match nothing.
    """
    bins = F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long")))
    spread = intervals.where((F.col(lo) <= F.col(hi))).withColumn("__bin", bins)
    placed = points.where(F.col(point).isNotNull()).withColumn("__bin", F.floor(F.col(point) / width).cast("long"))
    met = placed.join(spread, [*by, "__bin"]).where((F.col(lo) <= F.col(point)) & (F.col(point) <= F.col(hi)))
    return met.drop("__bin")
