"""Hybrid retrieval over many queries at once: lexical and vector lists, fused by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.vectors import cosine
from inkwell.session import small_enough

WORD = "[\\p{L}\\p{N}][\\p{L}\\p{M}\\p{N}]*"
QUERY_WORD = "[A-Za-z\\u0980-\\u09FF]{4,}"
# Words too common to identify a text.
STOP_WORDS = (
    "the a an and or of to in is are was were be been for on at by with from that this "
    "which it its as if then than so such not no do does did can could will would may "
    "might shall should must have has had following gives shown diagram figure table"
).split()
# Fusion constant, depth of a list, weights by query language, field weights.
RRF_K = 60
DEPTH = 30
WEIGHTS = {"en": (0.6, 0.4), "bn": (0.4, 0.6)}  # dense, sparse
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def tokens(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), F.lit(1))


def _only_words(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of df with one of the wanted words, which are sent to the tasks if there are few."""
    wanted = wanted.distinct()
    return df.join(F.broadcast(wanted) if small_enough(wanted, 200_000) else wanted, column, "left_semi")


def postings(df: DataFrame, key: str, scope: str, fields: dict[str, str], asked: DataFrame | None = None) -> DataFrame:
    """key, scope, token, weight: the summed field weights of each token of a text; fields maps a column to its class A, B or C.

    asked: the tokens that are wanted (a column token); others are left out before anything is counted.
    """
    parts = None
    for column, klass in fields.items():
        one = df.select(key, scope, F.explode(tokens(F.col(column))).alias("token"), F.lit(FIELD_WEIGHTS[klass]).alias("w"))
        parts = one if parts is None else parts.unionByName(one)
    if asked is not None:
        parts = _only_words(parts, asked.select("token"), "token")
    return parts.groupBy(key, scope, "token").agg(F.round(F.sum("w"), 6).alias("weight"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, tf of the words of four letters or more that aren't stop words."""
    words = df.select(key, F.explode(tokens(F.col(text), QUERY_WORD)).alias("word")).where(~F.col("word").isin(STOP_WORDS))
    return words.groupBy(key, "word").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """word, df: how many rows hold each word (one of `wanted`, a column word, if given).

    A row gives each of its words once, so words are added up where they lie and only one row a word and task is shuffled.
    """
    words = df.select(F.explode(F.array_distinct(tokens(F.col(text), QUERY_WORD))).alias("word")).where(~F.col("word").isin(STOP_WORDS))
    words = words if wanted is None else _only_words(words, wanted.select("word"), "word")
    return words.groupBy("word").agg(F.count("*").alias("df"))


def distinctive_terms(counts: DataFrame, frequencies: DataFrame, key: str, total: Column | int, *, terms: int = 8, least: int = 4) -> DataFrame:
    """key, word, rank: the `terms` words of each text with the best tf * ln(N / (1 + df)), ties in alphabetical order.

    counts: term_counts of the texts that queries are made from; frequencies: document_frequencies of the whole corpus of
    `total` texts. Texts with fewer than `least` different words give no query.
    """
    n = total if isinstance(total, Column) else F.lit(total)
    score = F.round(F.col("tf") * F.log(n / (1 + F.col("df"))), 9)
    scored = counts.join(frequencies, "word").withColumn("score", score)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "word")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= terms)
    return ranked.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") >= least).select(key, "word", "rank")


def ranked_list(scored: DataFrame, query: str, key: str, depth: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def lexical(queries: DataFrame, index: DataFrame, *, query: str, key: str, scope: str, depth: int = DEPTH) -> DataFrame:
    """query, key, score, rank: texts of the query's scope by the summed weights of the query's words (any of them may match).

    queries has query, scope, token. The scope is part of the join key, so nothing outside it is scored.
    """
    met = index.join(queries.select(query, scope, "token").distinct(), [scope, "token"])
    return ranked_list(met.groupBy(query, key).agg(F.round(F.sum("weight"), 6).alias("score")), query, key, depth)


def semantic(
    queries: DataFrame, vectors: DataFrame, *, query: str, key: str, vector: str, scope: str | None = None, depth: int = DEPTH, send_rows: int = 10_000
) -> DataFrame:
    """query, key, score, rank: exact cosine search of a stated query set over all vectors, within the query's scope if there is one.

    The queries are sent to the vectors if there are at most send_rows of them; else both are joined on the scope, or,
    without one, sent block by block.
    Null vectors and zero vectors take no part.
    """
    q = queries.select(query, F.col(vector).alias("__q"), *([scope] if scope else [])).where(F.col("__q").isNotNull())
    v = vectors.select(key, vector, *([scope] if scope else [])).where(F.col(vector).isNotNull())
    few = small_enough(q, send_rows)
    if scope and not few:
        met = v.join(q, scope)
    else:  # the query set against all rows, in blocks of a bounded size
        blocks = 1 if few else -(-q.count() // max(1, send_rows // 2))
        met = None
        for k in range(blocks):
            part = F.broadcast(q.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == k))
            one = v.join(part, scope) if scope else v.join(part)
            met = one if met is None else met.unionByName(one)
    scored = met.select(query, key, F.round(cosine(F.col(vector), F.col("__q")), 6).alias("score")).where("score is not null")
    return ranked_list(scored, query, key, depth)


def fuse(dense: DataFrame, sparse: DataFrame, languages: DataFrame, *, query: str, key: str, limit: int = 8) -> DataFrame:
    """query, key, fused, dense_rank, sparse_rank, retrievers, rank: weighted reciprocal ranks, weights by the query's language.

    languages has query and lang; any language but bn takes the weights of en.
    """
    both = dense.select(query, key, F.col("rank").alias("dense_rank")).join(sparse.select(query, key, F.col("rank").alias("sparse_rank")), [query, key], "full_outer")
    both = both.join(languages, query)
    part = lambda rank, k: F.when(F.col("lang") == "bn", WEIGHTS["bn"][k]).otherwise(WEIGHTS["en"][k]) / (RRF_K + F.col(rank))
    fused = F.coalesce(part("dense_rank", 0), F.lit(0.0)) + F.coalesce(part("sparse_rank", 1), F.lit(0.0))
    names = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "semantic"), F.when(F.col("sparse_rank").isNotNull(), "lexical")))
    rows = both.select(query, key, F.round(fused, 9).alias("fused"), "dense_rank", "sparse_rank", F.array_join(names, "+").alias("retrievers"))
    w = Window.partitionBy(query).orderBy(F.desc("fused"), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rerank(ranked: DataFrame, scores: DataFrame, *, query: str, key: str, pool: int = 20, bonus: float = 0.02) -> DataFrame:
    """Reorder the first `pool` of each list by score plus a bonus for authority; the tail keeps its order.

    scores has query, key, score (a missing one counts -1) and priority (1 is the highest authority, 4 the lowest or none).
    """
    rows = ranked.join(scores, [query, key], "left")
    prio = F.least(F.coalesce("priority", F.lit(4)), F.lit(4))
    value = F.round(F.coalesce("score", F.lit(-1.0)) + bonus * (4 - prio), 9)
    inside = F.col("rank") <= pool
    w = Window.partitionBy(query).orderBy(F.desc(inside), F.when(inside, -value).otherwise(F.col("rank").cast("double")), key)
    return rows.select(query, key, F.col("rank").alias("before"), F.row_number().over(w).alias("rank"))


def known_item(ranked: DataFrame, asked: DataFrame, *, query: str, key: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """evaluated, recall_at_1, recall_at_k, mrr, passed (recall_at_k of at least `threshold`) of lists whose right answer is the
    text a query was made from; half-even rounding to 4 places.

    asked has query, and own where the right answer isn't the query's own key.
    """
    right = asked.select(query, F.col("own" if "own" in asked.columns else query).alias("__own")).distinct()
    hit = ranked.join(right, query).where(F.col("__own") == F.col(key)).select(query, F.col("rank").alias("place"))
    rows = right.select(query).join(hit, query, "left")
    share = lambda cond: F.bround(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    one = rows.agg(
        F.count("*").alias("evaluated"),
        share(F.col("place") == 1).alias("recall_at_1"),
        share(F.col("place") <= k).alias("recall_at_k"),
        F.bround(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 4).alias("mrr"),
    )
    return one.withColumn("passed", F.coalesce(F.col("recall_at_k") >= threshold, F.lit(False)))


def diagnostics(dense: DataFrame, sparse: DataFrame, fused: DataFrame, queries: DataFrame, available: DataFrame, *, query: str) -> DataFrame:
    """query, lang, lexical_found, semantic_found, embedded, candidates, notes: what each retriever had for each query.

    queries has query, lang and scope; available has scope and embedded, the vectors there are. A query whose scope has none
    says so in its notes, and so does one that found nothing; an empty list makes zeros, not a missing row.
    """
    n = lambda df, name: df.groupBy(query).agg(F.count("*").alias(name))
    rows = queries.select(query, "lang", "scope").join(available, "scope", "left")
    for df, name in ((sparse, "lexical_found"), (dense, "semantic_found"), (fused, "candidates")):
        rows = rows.join(n(df, name), query, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    notes = F.array_compact(F.array(F.when(zero("embedded") == 0, "no vectors in scope"), F.when(zero("candidates") == 0, "nothing found")))
    return rows.select(query, "lang", *[zero(c).alias(c) for c in ("lexical_found", "semantic_found", "embedded", "candidates")], F.array_join(notes, "; ").alias("notes"))
