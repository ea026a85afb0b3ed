"""Mixing sources to target weights (problem 8).

Each source gets a budget of tokens. Whole passes over the source take most of it; the rest is a subset-sum problem over
the source's histogram of exact text lengths, solved by a bounded knapsack in which a text may be used as often as its
source's cap still allows, and texts are then drawn by a seeded hash, so many of each length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.ranks import spread_ranks
from inkwell.session import staged

WINDOW = 1 << 15


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many texts of each length to take so that their sum is as near below the budget as can be reached.

    A share of every length is taken first, then the longest that fit, until what is left is within the window;
    the last part is fitted exactly by a bounded knapsack over the texts still there. The window is at least as large as
    the longest text, so that every text stays a choice.
    """
    window = max(window, int(lengths[counts > 0].max(initial=0)))
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    # exact integers: the share of each length, less one part in eight to leave room for the fit where the budget is small
    share = budget if budget > 8 * window else 0
    take = np.array([int(c) * share // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= window:
            break
        k = min(int(counts[i] - take[i]), (left - window // 2) // int(lengths[i]))
        if k > 0:
            take[i] += k
            left -= k * int(lengths[i])
    # bounded knapsack on what is left; reached[n] holds, as bits, the sums the first n parts can make
    room = min(left, 2 * window)
    parts: list[tuple[int, int]] = []
    for i in np.flatnonzero((counts > take) & (lengths <= room)):
        have, k = min(int(counts[i] - take[i]), room // int(lengths[i])), 1
        while have > 0:
            parts.append((i, min(k, have)))
            have -= k
            k *= 2
    mask, reached = (1 << (room + 1)) - 1, [1]
    for i, k in parts:
        reached.append((reached[-1] | reached[-1] << int(lengths[i]) * k) & mask)
        if reached[-1] >> room & 1:
            break
    at = reached[-1].bit_length() - 1
    for n in range(len(reached) - 1, 0, -1):
        if not reached[n - 1] >> at & 1:
            i, k = parts[n - 1]
            take[i] += k
            at -= int(lengths[i]) * k
    return take


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", tokens: str = "tokens", seed: int = 3, total: int | None = None) -> DataFrame:
    """key, source, tokens, times: the texts drawn and how often each is used (at least once, at most max_repeats of its source).

    total: tokens of the whole mixture; by default the largest at which no source needs more than max_repeats passes.
    Texts with a null key or source, a source without target, or no tokens take no part; a key stored twice counts
    once. Sources with target but without texts, a null or non-positive share or cap, get nothing and don't bound
    the total. Empty tables give no rows. Only one row per source is brought together; histograms stay distributed.
    """
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{tokens}`").cast("long").alias("tokens"))
    src = staged(src.where("key is not null and source is not null and tokens > 0").dropDuplicates(["key"]), "sizes")
    hist = src.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    sums = hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("have"))
    goal = targets.select("source", "target_share", "max_repeats").where("target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
    goal = goal.join(sums, "source")
    if total is None:
        total = goal.agg(F.min(F.col("have") * F.col("max_repeats") / F.col("target_share"))).first()[0]
    if total is None:
        return src.withColumn("times", F.lit(0)).where(F.lit(False)).withColumnRenamed("key", key)
    budget = F.floor(F.col("target_share") * F.lit(float(total)) + F.lit(1e-6))
    goal = goal.withColumn("budget", F.least(budget, F.col("have") * F.col("max_repeats")))
    goal = goal.withColumn("passes", F.expr("budget div have")).withColumn("rest", F.expr("budget % have"))
    goal = goal.withColumn("again", F.col("max_repeats") - F.col("passes")).select("source", "passes", "rest", "again")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per length of a source
        pdf = pdf.sort_values("tokens")
        lengths, counts, rest = pdf["tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["rest"].iloc[0])
        take = fit_budget(lengths, counts, rest)
        if int((take * lengths).sum()) < rest:  # no choice of texts used once more makes it; some may be used several times
            more = fit_budget(lengths, counts * max(1, int(pdf["again"].iloc[0])), rest)
            take = more if int((more * lengths).sum()) > int((take * lengths).sum()) else take
        pdf["take"] = take
        return pdf[["source", "tokens", "n", "passes", "take"]]

    plan = hist.join(goal, "source").groupBy("source").applyInPandas(fit, "source string, tokens long, n long, passes long, take long")
    ranked = spread_ranks(src, ["source", "tokens"], F.xxhash64(F.lit(seed), "key"), "key")
    drawn = ranked.join(plan, ["source", "tokens"])
    # `take` uses of a length spread over its n texts: every text take div n times, the first take % n once more
    extra = F.expr("take div n") + F.when(F.col("rank") < F.expr("take % n"), 1).otherwise(0)
    times = (F.col("passes") + extra).cast("int").alias("times")
    return drawn.select(F.col("key").alias(key), "source", "tokens", times).where("times > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, texts, most_used, tokens, share reached; sources without a drawn text show 0."""
    got = drawn.groupBy("source").agg(F.count("*").alias("texts"), F.max("times").alias("most_used"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(F.broadcast(whole))
    return rows.select("source", "target_share", "max_repeats", zero("texts"), zero("most_used"), zero("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("whole")).alias("share"))
