"""Filling containers of fixed capacity (problem 7).

The texts are reduced to a histogram of sizes, which has at most as many rows as the capacity has tokens
whatever the number of texts. The configuration linear program over it is solved by multiplicative weights to a stated
duality gap: knapsacks priced with the dual give patterns of sizes, a size covered short of its count gains price, one
covered beyond it loses price, and each pattern's use is multiplied by the worth of what it holds. The uses are rounded to whole
ones by a seeded draw that takes about the same part of every size, and the program is solved again for the items left,
again and again until few are; these last ones are filled container by container, each around the largest item left, by
a knapsack in which an item is worth its size.
Spark then hands the patterns out: a text's rank among those of its size tells its container.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.ranks import spread_ranks
from inkwell.session import staged

GAP = 0.01  # the configuration LP is solved to within this share of its optimum
PART = 0.6  # part of the uses that one rounding takes
LAST = 0.04  # share of the tokens below which the rest isn't worth another LP
GROUP = 16  # sizes that a knapsack which makes patterns sees at once, so that patterns don't all hold the same few sizes
KEPT = (1.0, 0.98, 0.95, 0.92, 0.9, 0.85, 0.8, 0.7, 0.5, 0.25, 0.0)


def price_patterns(sizes: np.ndarray, limits: np.ndarray, worth: np.ndarray, capacity: int, among: np.ndarray, build: bool = True) -> tuple[float, list[tuple]]:
    """Bounded knapsack by dynamic programming over the sizes `among`: the worth of the best pattern, and a best pattern around one item of each.

    A pattern is a tuple of (index of the size, how many). One table serves all sizes: around size i stands what the table
    holds for the room its item leaves. Without build only the worth is found.
    """
    parts: list[tuple[int, int]] = []
    for i in among[limits[among] > 0]:
        left, k = int(min(limits[i], capacity // sizes[i])), 1
        while left > 0:
            parts.append((int(i), min(k, left)))
            left -= k
            k *= 2
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(parts) if build else 1, capacity + 1), bool)
    for n, (i, take) in enumerate(parts):
        w = int(sizes[i]) * take
        n = n if build else 0
        better = value[: capacity + 1 - w] + worth[i] * take
        won = better > value[w:] + 1e-12
        taken[n, w:] = won
        value[w:] = np.where(won, better, value[w:])
    if not build:
        return float(value[capacity]), []
    around = among[limits[among] > 0]
    room = capacity - sizes[around].astype(np.int64)
    held: list[dict[int, int]] = [{int(i): 1} for i in around]
    for n in range(len(parts) - 1, -1, -1):
        i, take = parts[n]
        for r in np.flatnonzero(taken[n, room]):
            held[r][i] = min(held[r].get(i, 0) + take, int(limits[i]))
            room[r] -= int(sizes[i]) * take
    return float(value[capacity]), [tuple(sorted(h.items())) for h in held]


def fullest_pattern(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The largest item left and, of the others, a choice that fills the rest best; larger items are preferred."""
    pattern = np.zeros(len(sizes), np.int64)
    alive = np.flatnonzero(left)[::-1]  # sizes are in ascending order
    first = alive[0]
    pattern[first] = 1
    room = capacity - int(sizes[first])
    mask, reached, parts = (1 << (room + 1)) - 1, [1], []
    for i in alive:
        size = int(sizes[i])
        have, k = min(int(left[i] - pattern[i]), room // size), 1
        while have > 0 and not reached[-1] >> room & 1:
            take = min(k, have)
            parts.append((i, take))
            reached.append((reached[-1] | reached[-1] << size * take) & mask)
            have -= take
            k *= 2
        if reached[-1] >> room & 1:
            break
    at = reached[-1].bit_length() - 1
    for n in range(len(parts), 0, -1):
        if not reached[n - 1] >> at & 1:
            i, take = parts[n - 1]
            pattern[i] += take
            at -= int(sizes[i]) * take
    return pattern


class Fraction:
    """Fractional solution of the configuration LP: patterns, uses of each, and the bounds between which its optimum lies."""

    def __init__(self, patterns: list[tuple], uses: np.ndarray, primal: float, dual: float):
        self.patterns, self.uses, self.primal, self.dual, self.costs = patterns, uses, primal, dual, np.ones(len(patterns))

    @property
    def gap(self) -> float:
        return self.primal / self.dual - 1 if self.dual > 0 else 0.0


def fractional(
    sizes: np.ndarray, counts: np.ndarray, capacity: int, pool: list[tuple], rounds: int, *, gap: float = GAP, steps: int = 300, seed: int = 5
) -> Fraction:
    """The configuration LP (fewest containers that cover every count) by multiplicative weights, until its duality gap is at most `gap`.

    The price of a size starts as its share of the capacity, which is a dual solution, and is multiplied round by round by
    a power of what is needed of it over what is covered. In each round knapsacks with these prices add a pattern around
    every size, so all sizes are covered; then `steps` times each pattern's use is multiplied by the worth of its items, each
    counted by needed over covered. The uses, with containers of one size for what is short, bound the optimum from above; the prices, scaled
    so that the dearest pattern costs one container, bound it from below.
    """
    rng = np.random.default_rng(seed)
    live, need = counts > 0, counts.astype(float)
    price = sizes / capacity
    ratio = np.ones(len(sizes))
    alone = np.minimum(capacity // sizes, np.maximum(counts, 1))
    seen = dict.fromkeys(pool)
    uses, best, low = np.zeros(0), Fraction([], np.zeros(0), np.inf, 0.0), 0.0
    for n in range(rounds):
        for dual in (price,) if n == 0 else (price, price * ratio):
            dual = dual / price_patterns(sizes, counts, dual, capacity, np.arange(len(sizes)), build=False)[0]
            if float((dual * need).sum()) > low * (1 + 1e-12):
                low, held = float((dual * need).sum()), dual
        if best.primal <= (1 + gap) * low:
            break
        for among in np.array_split(rng.permutation(np.flatnonzero(live)), max(1, int(live.sum()) // GROUP)):
            seen.update(dict.fromkeys(price_patterns(sizes, counts, price * np.clip(ratio, 0.1, 10), capacity, among)[1]))
        patterns = list(seen)
        ends = np.cumsum([0, *map(len, patterns)])
        flat = np.array([e for p in patterns for e in p], np.int64)
        row, many, col = flat[:, 0], flat[:, 1].astype(float), np.repeat(np.arange(len(patterns)), np.diff(ends))
        uses = np.concatenate([uses, np.full(len(patterns) - len(uses), uses.mean() if len(uses) else 1.0)])
        for _ in range(steps):
            ratio = need / np.maximum(np.bincount(row, many * uses[col], len(sizes)), 1e-12)
            uses = uses * np.add.reduceat((price * ratio)[row] * many, ends[:-1])
        covered = np.bincount(row, many * uses[col], len(sizes))
        ratio = need / np.maximum(covered, 1e-12)
        primal = float(uses.sum() + (np.maximum(need - covered, 0) / alone).sum())
        if primal < best.primal:
            best = Fraction(patterns, uses.copy(), primal, low)
        price = price * np.clip(ratio, 0.2, 5) ** 0.2
    best.dual, best.costs = low, np.array([sum(held[i] * a for i, a in p) for p in best.patterns])
    return best


def rounded(found: Fraction, left: np.ndarray, part: float, rng: np.random.Generator) -> list[tuple[tuple, int]]:
    """Whole uses of the patterns without loss, each drawn around `part` of its fractional use, as far as items are left (left is reduced).

    The draw favours no size, so what is left is much like what was there and can be packed as well.
    """
    plan: list[tuple[tuple, int]] = []
    times = np.floor(found.uses * part + rng.random(len(found.uses))).astype(np.int64)
    order = np.flatnonzero((times > 0) & (found.costs > 1 - 1e-9))
    for n in sorted(order, key=lambda n: -found.patterns[n][-1][0]):  # patterns of large items first
        pattern = found.patterns[n]
        k = min(int(times[n]), *(int(left[i]) // a for i, a in pattern))
        if k > 0:
            plan.append((pattern, k))
            for i, a in pattern:
                left[i] -= a * k
    return plan


def fill_greedily(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Container by container, each around the largest item left (left is used up)."""
    plan = []
    while left.any():
        pattern = fullest_pattern(sizes, left, capacity)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 120, facts: dict | None = None, seed: int = 5) -> list[tuple[np.ndarray, int]]:
    """(pattern, uses) that together hold counts[i] items of sizes[i] (ascending), each pattern within the capacity.

    The LP is solved and part of it rounded, again and again for the items left, until few are left or rounding places
    none. The greedy fill takes the rest. Where it lacks small items for that, it gets back patterns of many items:
    of several shares of the rounded plan, in the order of items a pattern, that one is kept which needs the fewest
    containers, the largest of equals. facts, if given, receives containers, by_lp (those that hold a rounded pattern),
    the containers by share kept, primal, dual and gap of the first LP.
    """
    rng = np.random.default_rng(seed)
    left = counts.astype(np.int64).copy()
    volume = int((left * sizes).sum())
    first: Fraction | None = None
    pool: list[tuple] = []
    placed: list[tuple[tuple, int]] = []
    while rounds and int((left * sizes).sum()) > LAST * volume:
        found = fractional(sizes, left, capacity, pool, rounds if first is None else min(rounds, 8))
        first = first or found
        before = int((left * sizes).sum())
        placed += rounded(found, left, PART, rng)
        if int((left * sizes).sum()) > 0.99 * before:
            break
        pool = [p for p in found.patterns if all(left[i] >= a for i, a in p)]
    placed.sort(key=lambda used: sum(a for _, a in used[0]))
    ends = np.cumsum([k for _, k in placed]) if placed else np.zeros(0, np.int64)
    best: list[tuple[np.ndarray, int]] | None = None
    tried: dict[float, int] = {}
    for share in KEPT if placed else (0.0,):
        kept = int(np.searchsorted(ends, share * ends[-1] + 0.5)) if placed else 0
        plan = []
        left = counts.astype(np.int64).copy()
        for pattern, times in placed[:kept]:
            dense = np.zeros(len(sizes), np.int64)
            dense[[i for i, _ in pattern]] = [a for _, a in pattern]
            plan.append((dense, times))
            left -= dense * times
        plan += fill_greedily(sizes, left, capacity)
        tried[share] = sum(k for _, k in plan)
        if best is None or tried[share] < sum(k for _, k in best):
            best, by_lp = plan, sum(k for _, k in placed[:kept])
    if facts is not None:
        facts.update(containers=sum(k for _, k in best), by_lp=by_lp, tried=tried)
        if first:
            facts.update(primal=first.primal, dual=first.dual, gap=first.gap)
    return best


def pack(df: DataFrame, key: str, tokens: str, capacity: int, *, seed: int = 5, facts: dict | None = None) -> DataFrame:
    """container, key, piece, start, tokens: every text in containers of at most `capacity` tokens.

    A text larger than the capacity is cut into full containers and a rest, which is packed like a text of its size
    (piece counts from 0, start is its first token); any other text is one piece. Texts with a null key, and null, zero
    or negative sizes, take no part; a key stored twice is packed twice; an empty table gives no rows. Which text
    of a size goes where is drawn by a seeded hash of its key. facts, if given, receives what solve() reports.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{tokens}`").cast("long").alias("size")).where("key is not null and size > 0")
    cut = staged(src.withColumn("full", F.expr(f"(size - 1) div {capacity}")), "items")
    full = cut.where("full > 0").select("key", F.posexplode(F.sequence(F.lit(1), F.col("full").cast("int"))).alias("piece", "k"))
    full = full.select("key", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("tokens"))
    rest = cut.select("key", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("start"), (F.col("size") - F.col("full") * capacity).alias("tokens"))
    hist = rest.groupBy("tokens").agg(F.count("*").alias("n")).orderBy("tokens").toPandas()  # at most `capacity` rows
    sizes, counts = hist["tokens"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    plan = solve(sizes, counts, capacity, facts=facts) if len(sizes) else []

    # for each size, from which rank on its texts go to which pattern, whose containers start at base
    table: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    used, base = np.zeros(len(sizes), np.int64), 0
    for pattern, times in plan:
        for i in np.flatnonzero(pattern):
            table[int(sizes[i])].append((int(used[i]), base, int(pattern[i])))
            used[i] += pattern[i] * times
        base += times
    held = df.sparkSession.sparkContext.broadcast({s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in table.items()})

    def place(batches):
        for b in batches:
            size, rank = np.asarray(b.column("tokens")), np.asarray(b.column("rank"))
            out = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                lo, start, many = held.value[int(s)]
                at = size == s
                k = np.searchsorted(lo, rank[at], side="right") - 1
                out[at] = start[k] + (rank[at] - lo[k]) // many[k]
            yield pa.RecordBatch.from_arrays([pa.array(out), *(b.column(c) for c in ("key", "piece", "start", "tokens"))], names=["container", "key", "piece", "start", "tokens"])

    ranked = spread_ranks(rest, ["tokens"], F.xxhash64(F.lit(seed), "key", "piece"), "key").select("key", "piece", "start", "tokens", "rank")
    schema = ranked.select(F.lit(0).cast("long").alias("container"), "key", "piece", "start", "tokens").schema
    packed = ranked.mapInArrow(place, schema)
    # a full piece fills a container of its own, numbered after the others
    slots = spread_ranks(full, ["tokens"], F.xxhash64(F.lit(seed), "key", "piece"), "key")
    alone = slots.select((F.col("rank") + base).alias("container"), "key", "piece", "start", "tokens")
    return packed.unionByName(alone)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """containers, tokens, least (the fewest containers that could hold them), empty_share."""
    one = packed.agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity)
    return one.select("containers", "tokens", least.alias("least"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("empty_share"))
