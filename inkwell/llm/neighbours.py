"""Most similar vectors for every vector (problem 2), by multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation of the principal axes) turn each direction
into a long binary code. The code is cut into m substrings and each is indexed: a vector has one index row per substring,
and vectors that agree in one come together in its bucket. There the tasks compare 128 other bits of the codes, buckets of
many vectors by a second multi-index in which every substring is probed as it stands and with each one bit flipped;
only pairs within the Hamming radius leave the task, and are then reranked on the floats.

The substrings get longer with the number of vectors, so that a bucket holds about as many at any size, and m grows with
them, so that a pair whose codes differ in `design` of their bits is met with probability `recall`. The design is the share
of bits in which directions of exactly the cosine asked for differ. Buckets that are too large or too dense for that are
worked through in blocks on the vectors themselves, where each vector keeps its k most similar.

Vectors that have fewer than k neighbours of that cosine are far from everything; no Hamming radius below half of the
bits holds their neighbours, so they are held against all vectors in blocks, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.samples import hash_sample
from inkwell.session import small_enough, staged

FILTER_BITS = 128
BUCKET = 4_096  # vectors that a bucket should hold
HOT = 4 * BUCKET  # buckets above this are worked through in blocks
SCAN = 3_072  # a bucket up to this size is compared as a whole, above it by probing
DENSE = 24  # pairs a vector that leave a bucket; where there are more, each vector keeps its k most similar instead
BLOCK = 12_288  # vectors of a block


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows usable as vectors (mask) and their unit vectors."""
    lists = column.cast(pa.list_(pa.float64()))
    lens = np.asarray(lists.value_lengths().fill_null(-1))
    ok = lens == dims
    flat = lists.filter(pa.array(ok)).flatten()
    x = np.asarray(flat.fill_null(np.nan), np.float64).reshape(-1, dims)
    fine = np.isfinite(x).all(1) & (x != 0).any(1) if len(x) else np.zeros(0, bool)
    ok[np.flatnonzero(ok)[~fine]] = False
    x = x[fine]
    if len(x):
        x = x / np.abs(x).max(1, keepdims=True)  # so that the squares of tiny or huge values neither vanish nor overflow
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ok, x


def _class_hash(x: np.ndarray) -> np.ndarray:
    """64 bits that equal directions share."""
    weights = np.random.default_rng(1).integers(1, 2**63, x.shape[1], dtype=np.int64).astype(np.uint64) | np.uint64(1)
    h = (np.round(x * 1e6).astype(np.int64).astype(np.uint64) * weights).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int = 128) -> DataFrame:
    """vec_id, same, unit (array<float> of length one) for rows whose vector has dims finite numbers, not all zero.

    same is a hash that vectors of equal direction share. Null, short, long, NaN, infinite and all-zero vectors and
    null keys are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _matrix(b.column(1), dims)
            ends = np.arange(len(x) + 1, dtype=np.int32) * dims
            units = pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(_class_hash(x)), units], names=["vec_id", "same", "unit"])

    src = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where("vec_id is not null")
    return src.mapInArrow(run, "vec_id long, same long, unit array<float>")


def learn_rotations(units: DataFrame, count: int, n: int, dims: int = 128, sample: int = 5_000, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """`count` orthogonal matrices, side by side, fitted to at most `sample` of about n vectors, taken by a seeded hash of their direction."""
    rows = hash_sample(units.select("same", "unit"), F.xxhash64(F.lit(seed), "same"), sample, n).toPandas()["unit"]
    rng = np.random.default_rng(seed)
    starts = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(count)]
    if len(rows) < 2:
        return np.hstack(starts)
    x = np.stack(rows.to_numpy()).astype(np.float64)
    x = x - x.mean(0)
    axes = np.linalg.svd(x.T @ x)[0]
    y = x @ axes
    out = []
    for r in starts:
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ vt).T
        out.append(axes @ r)
    return np.hstack(out)


def differing_share(cosine: float) -> float:
    """Share of the bits in which the codes of two vectors of this cosine differ: the angle between them over pi."""
    return math.acos(min(1.0, max(-1.0, cosine))) / math.pi


def code_shape(n: int, design: float, recall: float = 0.99, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits per substring and number of substrings for n vectors."""
    width = min(28, max(0, math.ceil(math.log2(max(n, 1) / bucket))))
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - design) ** width))) if width else 1


def filter_spread(design: float) -> int:
    """Differing bits allowed of the FILTER_BITS: two and a half standard deviations above what the design expects."""
    return math.ceil(FILTER_BITS * design + 2.5 * math.sqrt(FILTER_BITS * design * (1 - design)))


_INDEX = "bucket long, same long, half long, rest long"


def _index_rows(rotations: np.ndarray, width: int, pieces: int, dims: int):
    """For each different vector of a batch one index row per substring: bucket, the vector's class and 128 other bits of its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(width, dtype=np.int64)
        for b in batches:
            same, first = np.unique(np.asarray(b.column(0)), return_index=True)
            if not len(same):
                continue
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, dims)[first]
            bits = (x @ rotations > 0).astype(np.uint8)
            other = np.ascontiguousarray(np.packbits(bits[:, :FILTER_BITS], axis=1, bitorder="little")).view("<i8")
            for piece in range(pieces):
                at = FILTER_BITS + piece * width
                key = bits[:, at : at + width] @ weights if width else np.zeros(len(same), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key | (piece << width)), pa.array(same), pa.array(other[:, 0]), pa.array(other[:, 1])], names=["bucket", "same", "half", "rest"]
                )

    return run


def _probed(codes: np.ndarray, design: float, seed: int = 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose codes agree in one of m substrings but for at most one bit; a pair may come several times."""
    n = len(codes)
    width = max(4, round(math.log2(n)) - 3)
    meet = (1 - design) ** width + width * design * (1 - design) ** (width - 1)
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
    rng = np.random.default_rng(seed)
    for _ in range(math.ceil(math.log(0.002) / math.log(1 - meet))):
        key = bits[:, rng.choice(FILTER_BITS, width, replace=False)].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
        order = np.argsort(key, kind="stable")
        held = key[order]
        for flip in (0, *(1 << np.arange(width))):
            asked = order if not flip else order[held & flip == 0]  # a pair that differs in this bit is met from the side without it
            lo = np.searchsorted(held, key[asked] ^ flip, "left") if flip else np.arange(n) + 1
            hi = np.searchsorted(held, key[asked] ^ flip, "right")
            many = np.maximum(hi - lo, 0)
            ends = np.cumsum(many)
            for a in range(0, n if len(asked) else 0, SCAN):
                m = many[a : a + SCAN]
                if m.sum():
                    base = np.repeat(lo[a : a + SCAN] - (ends[a : a + SCAN] - m) + (ends[a - 1] if a else 0), m)
                    yield np.repeat(asked[a : a + SCAN], m), order[base + np.arange(m.sum())]


def bucket_pairs(codes: np.ndarray, spread: int, design: float, most: int) -> np.ndarray | None:
    """Pairs of rows of codes (n x 2 words) that differ in at most `spread` bits, as n x 2 places; None where there are more than `most`."""
    out: list[np.ndarray] = []
    n, total = len(codes), 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal total
        ok = (np.bitwise_count(codes[a, 0] ^ codes[b, 0]) + np.bitwise_count(codes[a, 1] ^ codes[b, 1])) <= spread
        out.append(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])], axis=1))
        total += int(ok.sum())

    if n > SCAN:
        for a, b in _probed(codes, design):
            keep(a, b)
            if total > 4 * most:  # pairs met several times are counted once
                out = [np.unique(np.vstack(out), axis=0)]
                total = len(out[0])
                if total > most:
                    return None
    else:
        for lo in range(0, n, 256):
            far = np.bitwise_count(codes[lo : lo + 256, 0][:, None] ^ codes[lo:, 0]) + np.bitwise_count(codes[lo : lo + 256, 1][:, None] ^ codes[lo:, 1])
            a, b = np.nonzero(far <= spread)
            out.append(np.stack([a, b], axis=1)[a < b] + lo)
            total += len(out[-1])
            if total > most:
                return None
    pairs = np.unique(np.vstack(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return None if len(pairs) > most else pairs


def _small_copies(units: DataFrame, dims: int) -> DataFrame:
    """same, small: each direction once, as signed bytes, a quarter of its floats and precise enough to choose what is reranked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, first = np.unique(np.asarray(b.column(0)), return_index=True)
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, dims)[first]
            small = np.round(127 * x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-30)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(same), pa.array([r.tobytes() for r in small], pa.binary())], names=["same", "small"])

    return units.select("same", "unit").mapInArrow(run, "same long, small binary").dropDuplicates(["same"])


def _best_columns(cos: np.ndarray, k: int, group: int = 64) -> np.ndarray:
    """Places of the k largest values of every row: those of the k groups of columns with the largest maxima are looked at."""
    rows, n = cos.shape
    if n <= 4 * k * group:
        return np.argpartition(-cos, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (rows, 1))
    cut = n // group * group
    tops = cos[:, :cut].reshape(rows, -1, group).max(2)
    best = np.argpartition(-tops, k - 1, axis=1)[:, :k]
    cols = np.hstack([(best[:, :, None] * group + np.arange(group)).reshape(rows, -1), np.tile(np.arange(cut, n), (rows, 1))])
    sub = np.take_along_axis(cos, cols, axis=1)
    return np.take_along_axis(cols, np.argpartition(-sub, k - 1, axis=1)[:, :k], axis=1)


def block_pairs(rows: DataFrame, k: int, floor: float, dims: int) -> DataFrame:
    """sa, sb (sa < sb): each asking vector's k most similar of every block of its group, if not below floor.

    rows has grp, blocks, same, asks, small. A vector goes to each pair of blocks its own is part of; a task sees two blocks
    and emits k rows a vector, never all pairs.
    """
    mine = rows.withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = mine.select("grp", "same", "asks", "block", other, "small")
    spread = spread.select("grp", "same", "asks", "block", "small", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def best(key, table):
        same, first = np.unique(table.column("same").to_numpy(), return_index=True)
        block, asks = table.column("block").to_numpy()[first], table.column("asks").to_numpy(zero_copy_only=False)[first]
        x = np.frombuffer(b"".join(table.column("small").to_pylist()), np.int8).reshape(-1, dims)[first].astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        lo, hi = key[1].as_py(), key[2].as_py()
        found: list[np.ndarray] = []
        for a, b in ((lo, hi),) if lo == hi else ((lo, hi), (hi, lo)):
            asking, there = np.flatnonzero((block == a) & asks), np.flatnonzero(block == b)
            for at in range(0, len(asking) if len(there) else 0, 1024):
                part = asking[at : at + 1024]
                cos = x[part] @ x[there].T
                if a == b:
                    cos[np.arange(len(part)), np.searchsorted(there, part)] = -2
                top = _best_columns(cos, min(k, len(there)))
                ok = np.take_along_axis(cos, top, axis=1) >= max(floor, -1.5)
                p, q = np.repeat(same[part], top.shape[1])[ok.ravel()], same[there[top.ravel()]][ok.ravel()]
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
        pairs = np.unique(np.vstack(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"sa": pa.array(pairs[:, 0], pa.int64()), "sb": pa.array(pairs[:, 1], pa.int64())})

    return spread.groupBy("grp", "lo", "hi").applyInArrow(best, "sa long, sb long")


def _sent(df: DataFrame, most: int = 200_000) -> DataFrame:
    return F.broadcast(df) if small_enough(df, most) else df


def similar_pairs(units: DataFrame, n: int, min_cosine: float, dims: int = 128, sample: int = 5_000, k: int = 5, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """sa, sb: classes of vectors that share a bucket and are within the Hamming radius of min_cosine (sa < sb), to be reranked.

    Every bucket is counted. Those of more than `hot` vectors, and those in which more than DENSE pairs a vector are near, are
    worked through in blocks, where each vector's k + 3 most similar are kept.
    """
    design = differing_share(min_cosine)
    width, pieces = code_shape(n, design, bucket=bucket)
    spread = filter_spread(design)
    rotations = learn_rotations(units, -(-(FILTER_BITS + pieces * width) // dims), n, dims, sample)
    index = units.select("same", "unit").mapInArrow(_index_rows(rotations, width, pieces, dims), _INDEX)
    sizes = index.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("bucket")
    large = staged(sizes, "hot") if width else None
    large = None if large is None or large.isEmpty() else large
    usual = index if large is None else index.join(_sent(large), "bucket", "left_anti")

    def scan(key, table):
        same, first = np.unique(table.column("same").to_numpy(), return_index=True)
        codes = np.stack([table.column(c).to_numpy()[first] for c in ("half", "rest")], axis=1).view(np.uint64)
        pairs = bucket_pairs(codes, spread, design, DENSE * len(same))
        if pairs is None:
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "sa": pa.array([None], pa.int64()), "sb": pa.array([None], pa.int64())})
        none = pa.nulls(len(pairs), pa.int64())
        return pa.table({"bucket": none, "sa": pa.array(same[pairs[:, 0]]), "sb": pa.array(same[pairs[:, 1]])})

    met = staged(usual.groupBy("bucket").applyInArrow(scan, "bucket long, sa long, sb long"), "met")
    near = met.where("bucket is null").select("sa", "sb")
    dense = met.where("bucket is not null").select("bucket")
    dense = dense if large is None else dense.unionByName(large)
    if not dense.isEmpty():
        dense = staged(dense, "dense")
        members = index.join(_sent(dense), "bucket").select(F.col("bucket").alias("grp"), "same")
        blocks = members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = members.join(_sent(blocks), "grp").join(_small_copies(units, dims), "same").withColumn("asks", F.lit(True))
        near = near.unionByName(block_pairs(rows, k + 3, min_cosine - 0.02, dims))
    return near.distinct()


def nearest_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "vector", *, k: int = 5, min_cosine: float | None = None, index_cosine: float = 0.80, dims: int = 128,
    sample: int = 5_000, bucket: int = BUCKET, hot: int = HOT
) -> DataFrame:
    """vec_id, other_id, cosine, rank: for every usable vector the k most similar others.

    The index is made for neighbours of min_cosine. Without min_cosine it is made for index_cosine, and vectors that don't have
    k neighbours of it are held against all vectors; with it, neighbours below min_cosine are left out by definition.
    Ties go to the smaller id. Vectors that are equal after scaling to length one form one class; the search runs
    on class representatives, and a class adds only its k + 1 smallest ids to any list, which is all that can be
    among the k most similar. So a class holding a third of all rows makes k rows per member, never all pairs.
    An empty table, or one without usable vectors, gives no rows. The rotation is fitted on `sample` vectors;
    every vector is indexed.
    """
    units = staged(usable_vectors(df, key, vector, dims), "units")
    classes = units.groupBy("same").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last"), F.count_distinct("vec_id").alias("size"))
    classes = staged(classes, "classes")
    heads = classes.select("same", "rep")
    va = units.select(F.col("vec_id").alias("a"), F.col("unit").alias("ua"))
    vb = units.select(F.col("vec_id").alias("b"), F.col("unit").alias("ub"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)

    def scored(met: DataFrame) -> DataFrame:
        ids = met.join(heads.toDF("sa", "a"), "sa").join(heads.toDF("sb", "b"), "sb").select("a", "b")
        return ids.join(va, "a").join(vb, "b").select("a", "b", F.round(dot, 6).alias("cosine")).dropDuplicates(["a", "b"])

    n, least = classes.count(), index_cosine if min_cosine is None else min_cosine
    pairs = staged(scored(similar_pairs(units, n, least, dims, sample, k, bucket, hot)).where(F.col("cosine") >= least), "pairs")
    if min_cosine is None:
        sizes = classes.select("rep", "size")
        ways = pairs.select(F.col("a").alias("of"), F.col("b").alias("rep")).unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("rep")))
        got = ways.join(sizes, "rep").groupBy("of").agg(F.sum("size").alias("near"))
        asks = F.col("size") - 1 + F.coalesce("near", F.lit(0)) < k
        rows = classes.join(got, F.col("rep") == F.col("of"), "left").select("same", asks.alias("asks"))
        rows = rows.join(_small_copies(units, dims), "same").withColumn("grp", F.lit(0)).withColumn("blocks", F.lit(max(1, -(-n // BLOCK))))
        far = scored(block_pairs(rows, k + 3, -2.0, dims))
        pairs = staged(pairs.unionByName(far).dropDuplicates(["a", "b"]), "all_pairs")

    # classes of several equal vectors: their members, and the k + 1 smallest ids of each
    several = classes.where("rep < last").select("same", "rep")
    members = units.select("vec_id", "same").join(several, "same").select("rep", "vec_id").distinct()
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    by_slot = Window.partitionBy("rep", "slot").orderBy("vec_id")
    by_rep = Window.partitionBy("rep").orderBy("vec_id")
    fewest = members.withColumn("slot", slot).withColumn("r", F.row_number().over(by_slot)).where(F.col("r") <= k + 1)
    fewest = fewest.withColumn("r", F.row_number().over(by_rep)).where(F.col("r") <= k + 1).select("rep", F.col("vec_id").alias("other_id"))

    # what each representative may list: the ids standing for its neighbour classes
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("near"), "cosine").unionByName(
        pairs.select(F.col("b").alias("rep"), F.col("a").alias("near"), "cosine")
    )
    far = both.join(fewest.select(F.col("rep").alias("near"), "other_id"), "near", "left")
    far = far.select("rep", F.coalesce("other_id", "near").alias("other_id"), "cosine")
    own = fewest.select("rep", "other_id", F.lit(1.0).alias("cosine"))
    ranked = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other_id")
    lists = far.unionByName(own).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    lists = lists.select("rep", "other_id", "cosine")

    alone = lists.join(members.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("vec_id"), "other_id", "cosine")
    grouped = members.join(lists, "rep").select("vec_id", "other_id", "cosine").where("vec_id <> other_id")
    final = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id")
    out = alone.unionByName(grouped).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return out.select("vec_id", "other_id", "cosine", "rank")


def neighbour_pairs(df: DataFrame, key: str = "vec_id", vector: str = "vector", *, k: int = 5, min_cosine: float = 0.80, dims: int = 128) -> DataFrame:
    """vec_lo, vec_hi: pairs of at least min_cosine of which one is among the other's k most similar vectors."""
    near = nearest_vectors(df, key, vector, k=k, min_cosine=min_cosine, dims=dims)
    return near.select(F.least("vec_id", "other_id").alias("vec_lo"), F.greatest("vec_id", "other_id").alias("vec_hi")).distinct()


def exact_nearest(
    df: DataFrame, key: str = "vec_id", vector: str = "vector", *, k: int = 5, min_cosine: float = -2.0, dims: int = 128, every: int = 100, at_once: int = 2_000, sent: int = 50_000
) -> DataFrame:
    """vec_id, other_id, cosine, rank by brute force for the query set of ids divisible by `every`.

    The queries are sent to the tasks, at most `sent` in one pass, and are held against the task's rows in blocks of
    at_once; each task keeps the k best of its own rows, so what is shuffled is k rows per query and batch. Used to
    measure the recall of nearest_vectors.
    """
    units = staged(usable_vectors(df, key, vector, dims).dropDuplicates(["vec_id"]), "units")
    asked = units.where(F.pmod("vec_id", F.lit(every)) == 0)
    passes = max(1, -(-asked.count() // sent))
    found = None
    for one in range(passes):
        q = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == one).toPandas()
        ids = q["vec_id"].to_numpy(np.int64)
        mat = np.stack(q["unit"].to_numpy()).astype(np.float64) if len(q) else np.zeros((0, dims))
        held = df.sparkSession.sparkContext.broadcast((ids, mat))

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            all_ids, all_mat = held.value
            for b in batches:
                x = np.asarray(b.column(2).flatten(), np.float64).reshape(b.num_rows, dims)
                own = np.asarray(b.column(0))
                for at in range(0, len(all_ids) if b.num_rows else 0, at_once):
                    ids, mat = all_ids[at : at + at_once], all_mat[at : at + at_once]
                    cos = np.round(mat @ x.T, 6)
                    cos[ids[:, None] == own[None, :]] = -3
                    order = np.lexsort((np.broadcast_to(own, cos.shape), -cos), axis=1)[:, :k]
                    row = np.repeat(np.arange(len(ids)), order.shape[1])
                    col = order.ravel()
                    fine = cos[row, col] >= min_cosine
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row[fine]]), pa.array(own[col[fine]]), pa.array(cos[row[fine], col[fine]])], names=["vec_id", "other_id", "cosine"]
                    )

        part = units.mapInArrow(best, "vec_id long, other_id long, cosine double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
