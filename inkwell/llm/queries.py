"""The queries of this subpackage, over the tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import formatdup, junk, language, mixing, neighbours, packing, printform, scans, tokens
from inkwell.session import shared_folder
from inkwell.sources.tables import table


_SLICED = [
    ("documents", "doc_id", "text", ["source", "lang", "domain"]),
    ("chunks", "chunk_id", "text", ["offering_id", "language", "chunk_type"]),
]


def _ledger(spark: SparkSession) -> tokens.Ledger:
    return tokens.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


def _one_shape(cube: DataFrame, name: str, slices: list[str]) -> DataFrame:
    return cube.select(F.lit(name).alias("tbl"), *[F.col(s).alias(f"slice_{i}") for i, s in enumerate(slices, 1)], "texts", "tokens")


def p1_budget(spark: SparkSession, d: str) -> DataFrame:
    """Texts and tokens of every slice: documents by source, lang and domain, chunks by offering, language and type."""
    ledger = _ledger(spark)
    parts = [_one_shape(tokens.budget(table(spark, d, name), key, text, slices, ledger=ledger), name, slices) for name, key, text, slices in _SLICED]
    return parts[0].unionByName(parts[1])


def p1_text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every text, through the ledger."""
    ledger, out = _ledger(spark), None
    for name, key, text, slices in _SLICED:
        rows = table(spark, d, name)
        counts = ledger.extend(rows, text).select("content", "tokens")
        one = tokens.state(rows, key, text, []).where("content is not null").join(counts, "content")
        one = one.select(F.col(key).cast("string").alias("row_key"), "tokens", F.lit(name).alias("tbl"))
        out = one if out is None else out.unionByName(one)
    return out


def _states(spark: SparkSession, d: str, name: str) -> list[DataFrame]:
    """A table as it may have stood at three times: the first two thirds of its period, with raw texts and labels as written;
    the last two thirds, with the texts and labels of today; and as it is. Between them rows come, go and change."""
    rows, at = table(spark, d, name), {"documents": "added_at", "chunks": "created_at"}[name]
    when = F.unix_micros(F.col(at).cast("timestamp"))
    thirds = rows.agg(F.percentile_approx(when, [1 / 3, 2 / 3]).alias("t")).first().t or [0, 0]
    if name == "chunks":
        older = rows.withColumn("text", F.coalesce("text_raw", "text")).withColumn("language", F.lower("language"))
    else:
        older = rows.withColumn("text", F.rtrim("text")).withColumn("lang", F.lower(F.trim("lang")))
    return [older.where(when <= thirds[1]), rows.where(when > thirds[0]), rows]


def p1_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """The cubes of p1_budget, built for an earlier state of the tables and brought up to date twice by signed deltas: for rows
    removed, changed and added, and for rows that come back. The ledger is kept between the three runs."""
    ledger, tok, out = _ledger(spark), tokens.TokenizerFile(), None
    for name, key, text, slices in _SLICED:
        cube, before = tokens.empty_cube(spark, slices), None
        for rows in _states(spark, d, name):
            after = tokens.staged(tokens.state(rows, key, text, slices), "state")
            deltas = tokens.signed_deltas(before, after, key, slices, ledger.extend(rows, text), tok)
            cube, before = tokens.staged(tokens.apply_deltas(cube, deltas, slices), "cube"), after
        one = _one_shape(cube, name, slices)
        out = one if out is None else out.unionByName(one)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "chunk_vectors"))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, d, "chunk_vectors"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """By band of cosine, the exact neighbours of the query set (ids divisible by 100) and those of them that p2_nearest has."""
    vectors = table(spark, d, "chunk_vectors")
    exact = neighbours.exact_nearest(vectors).select("vec_id", "other_id", "cosine")
    got = neighbours.nearest_vectors(vectors).select("vec_id", "other_id", F.lit(1).alias("hit"))
    band = F.when(F.col("cosine") >= 0.9, "0.90").when(F.col("cosine") >= 0.85, "0.85").when(F.col("cosine") >= 0.8, "0.80").otherwise("below")
    both = exact.join(got, ["vec_id", "other_id"], "left").groupBy(band.alias("band"))
    return both.agg(F.count("*").alias("exact_neighbours"), F.count("hit").alias("found_neighbours"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_report(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "source_documents"))


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return language.all_labels(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "source_documents"))


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    return language.all_passages(table(spark, d, "documents"), table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copy_members(table(spark, d, "legacy_records"))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.distinct_records(table(spark, d, "legacy_records"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return scans.scanned_texts(table(spark, d, "ocr_pages"), table(spark, d, "chunks"), table(spark, d, "parsed_questions"))


def _findings(spark: SparkSession, d: str, texts: DataFrame) -> scans.Findings:
    titles = scans.title_skeletons(table(spark, d, "source_documents"), "source_document_id", "title")
    return scans.find(texts, table(spark, d, "documents"), "text", titles)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.marked_lines(_findings(spark, d, _scanned(spark, d)))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    texts = _scanned(spark, d)
    return scans.repaired(texts, _findings(spark, d, texts))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    sides = [("chunks", "chunk_id", "text"), ("legacy_records", "record_id", "content")]
    parts = [
        printform.lookalike_pairs(table(spark, d, t), key, text).select(F.lit(t).alias("tbl"), "first_key", "second_key") for t, key, text in sides
    ]
    return parts[0].unionByName(parts[1])


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p6_found's pairs with their class, one row each."""
    sides = [("chunks", "chunk_id", "text"), ("legacy_records", "record_id", "content")]
    parts = [printform.lookalike_classes(table(spark, d, t), key, text).withColumn("tbl", F.lit(t)) for t, key, text in sides]
    return parts[0].unionByName(parts[1])


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("text").cast("string").alias("text"))
    return tokens.counted(docs, "text")


def _capacity(spark: SparkSession, d: str, label: str) -> int:
    row = table(spark, d, "containers").where(F.col("label") == label).first()
    return int(row["capacity_tokens"])


def _packed(label: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return packing.pack(_sized(spark, d), "doc_id", "tokens", _capacity(spark, d, label)).withColumnRenamed("key", "doc_id")

    return query


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """For every row of `containers`: containers used, their tokens, the fewest possible and the empty share; of the rests, the
    containers that a pattern of the configuration LP filled, the LP's lower bound and the gap to which it was solved."""
    sizes = packing.staged(_sized(spark, d), "sizes")
    out = None
    for row in table(spark, d, "containers").orderBy("container_id").collect():  # one row per kind of container
        facts: dict = {}
        one = packing.fill_report(packing.pack(sizes, "doc_id", "tokens", int(row["capacity_tokens"]), facts=facts), int(row["capacity_tokens"]))
        lp = [F.lit(facts.get("by_lp", 0)).alias("lp_containers"), F.lit(facts.get("dual", 0.0)).alias("lp_bound"), F.lit(facts.get("gap", 0.0)).alias("lp_gap")]
        one = one.select(F.lit(row["container_id"]).alias("container_id"), "containers", "tokens", "least", "empty_share", *lp)
        out = one if out is None else out.unionByName(one)
    return out


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return junk.junk_pages(table(spark, d, "documents"))


def p9_shapes(spark: SparkSession, d: str) -> DataFrame:
    """How many pages, lines and characters each line shape has over the whole table."""
    shapes = junk.line_shapes(table(spark, d, "documents"))
    return shapes.groupBy("kind", "shape").agg(F.count("*").alias("pages"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the shape of junk that holds most of them."""
    return junk.junk_groups(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_budget, p1_text_tokens, p1_refreshed, p2_found, p2_nearest, p2_recall, p3_found, p3_labels, p3_passages, p4_found, p4_copies, p5_found, p5_repaired, p6_found, p6_classes,
        p7_report, p8_mix, p8_shares, p9_found, p9_shapes, p9_groups,
    )
    packs = {f"p7_pack_{label.split()[0]}": _packed(label) for label in ("medium window", "short window", "long window", "wide window")}
    return {**packs, **{f.__name__: f for f in named}}


# Brute force over all pairs of usable vectors.
P2_FOUND = """
WITH v AS (SELECT vec_id, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS x FROM chunk_vectors WHERE vec_id IS NOT NULL AND len(vector) = 128
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
u AS (SELECT DISTINCT ON (vec_id) vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.x, b.x) / (a.n * b.n), 6) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p WHERE c >= 0.8)
SELECT DISTINCT least(a, b) AS vec_lo, greatest(a, b) AS vec_hi FROM r WHERE k <= 5
"""

# Canonical records made whole, which the operator never does.
_BARE = "regexp_replace(lower({}), '[\\pP\\pZ\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+', '', 'g')"
_RECORDS = f"""
r AS (SELECT DISTINCT record_id, content, meta_json FROM legacy_records WHERE record_id IS NOT NULL AND json_valid(meta_json)
  AND regexp_replace(content, '[\\s\\pZ\\p{{Cf}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]+', '', 'g') <> ''),
o AS (SELECT *, json_keys(meta_json) AS ks FROM r WHERE json_type(meta_json) = 'OBJECT'),
c AS (SELECT record_id, {_BARE.format('content')} || chr(1) || array_to_string(list_sort(list_transform(ks, lambda k: {_BARE.format('k')} || chr(2) || {_BARE.format("coalesce(json_extract_string(meta_json, '$.' || chr(34) || k || chr(34)), 'null')")})), chr(1)) AS canon FROM o WHERE len(ks) > 0),
g AS (SELECT record_id, min(record_id) OVER (PARTITION BY canon) AS first_id FROM c)"""
P4_FOUND = f"WITH {_RECORDS} SELECT first_id, record_id AS other_id FROM g WHERE record_id > first_id"
P4_COPIES = f"WITH {_RECORDS} SELECT first_id, count(*) AS copies FROM g GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    """Where SQL can say the same on whole tables; tests hold the other queries against brute force, a rebuild or an exact round trip."""
    return {"p2_found": P2_FOUND, "p4_found": P4_FOUND, "p4_copies": P4_COPIES}
