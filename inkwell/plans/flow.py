"""Order and interval joins, upserts and deduplication by arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import strip
from inkwell.operators import joins, merge, parsing
from inkwell.sources.tables import table


def last_click(spark: SparkSession, d: str) -> DataFrame:
    """Each error event with the user's last click before it or at the same time."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts", "at")
    clicks = e.where("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("click_id"))
    day = 86_400_000_000
    return joins.asof_join(errors, clicks, ["user_id"], "at", ["click_id"], span=day).drop("at")


LAST_CLICK = """
SELECT e.event_id, e.user_id, e.ts, c.click_id FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON c.user_id = e.user_id AND e.ts >= c.ts
"""


def pages_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages inside the page range of a chunk of the same document."""
    p = table(spark, d, "ocr_pages").select("page_id", "source_document_id", F.col("page_number").alias("page"))
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "source_document_id", F.col("page_number").alias("lo"), F.coalesce("page_number_end", "page_number").alias("hi"))
    return joins.interval_join(p, c, ["source_document_id"], "page", "lo", "hi", width=4).select("chunk_id", "page_id")


PAGES_OF_CHUNKS = """
SELECT c.chunk_id, p.page_id FROM ocr_pages p JOIN (SELECT DISTINCT chunk_id, source_document_id, page_number AS lo, coalesce(page_number_end, page_number) AS hi FROM chunks) c
ON c.source_document_id = p.source_document_id AND p.page_number BETWEEN c.lo AND c.hi
"""


def pages_at_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The page that holds the middle character of each document's joined pages."""
    p = table(spark, d, "ocr_pages").where("text is not null and source_document_id is not null")
    p = p.groupBy("source_document_id", "page_number").agg(F.min_by("text", "page_id").alias("text"))
    half = p.groupBy("source_document_id").agg(F.floor((F.sum(F.length("text") + 1) - 1) / 2).alias("char_offset"))
    return parsing.page_of_offset(p, half, "source_document_id", "page_number", "text", "char_offset")


PAGES_AT_OFFSETS = """
WITH p AS (SELECT source_document_id, page_number, arg_min(text, page_id) AS text FROM ocr_pages WHERE text IS NOT NULL GROUP BY 1, 2),
s AS (SELECT source_document_id, page_number, coalesce(sum(length(text) + 1) OVER (PARTITION BY source_document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
h AS (SELECT source_document_id, CAST(floor((sum(length(text) + 1) - 1) / 2) AS BIGINT) AS char_offset FROM p GROUP BY 1)
SELECT h.source_document_id, h.char_offset, s.page_number FROM h ASOF LEFT JOIN s ON s.source_document_id = h.source_document_id AND h.char_offset >= s.start
"""

_KEYS = ["source_document_id", "question_number"]


def _two_parses(spark: SparkSession, d: str):
    q = table(spark, d, "parsed_questions").where("source_document_id is not null and question_number is not null")
    q = q.withColumn("body", strip(F.col("text_raw"))).select("question_id", *_KEYS, "marks", "body", "parsed_at")
    first = merge.latest_by(q, _KEYS, [F.col("parsed_at").asc_nulls_first(), "question_id"])
    last = merge.latest_by(q, _KEYS, [F.col("parsed_at").desc_nulls_last(), F.desc("question_id")])
    middle = "timestamp'2025-07-01'"
    return first.where(f"parsed_at < {middle}"), last.where(f"parsed_at >= {middle} or question_number <> '1'")


def parse_merge(spark: SparkSession, d: str) -> DataFrame:
    """What merging the last parse of every question into the first ones would do to each."""
    stored, incoming = _two_parses(spark, d)
    return merge.merge_plan(stored, incoming, _KEYS, ["marks", "body"])


_PARSES = """
q AS (SELECT question_id, source_document_id, question_number, marks, text_raw AS body, parsed_at FROM parsed_questions WHERE source_document_id IS NOT NULL AND question_number IS NOT NULL),
st AS (SELECT * FROM (SELECT DISTINCT ON (source_document_id, question_number) * FROM q ORDER BY source_document_id, question_number, parsed_at ASC NULLS FIRST, question_id) WHERE parsed_at < TIMESTAMP '2025-07-01'),
inc AS (SELECT * FROM (SELECT DISTINCT ON (source_document_id, question_number) * FROM q ORDER BY source_document_id, question_number, parsed_at DESC NULLS LAST, question_id DESC) WHERE parsed_at >= TIMESTAMP '2025-07-01' OR question_number <> '1')
"""
PARSE_MERGE = f"""
WITH {_PARSES}, f AS (SELECT coalesce(st.source_document_id, inc.source_document_id) AS source_document_id, coalesce(st.question_number, inc.question_number) AS question_number,
 CASE WHEN st.question_id IS NULL THEN 'created' WHEN inc.question_id IS NULL THEN 'pruned' WHEN st.marks IS NOT DISTINCT FROM inc.marks AND trim(st.body, E' \\t\\n\\r') IS NOT DISTINCT FROM trim(inc.body, E' \\t\\n\\r') THEN 'unchanged' ELSE 'updated' END AS action
 FROM st FULL OUTER JOIN inc ON st.source_document_id = inc.source_document_id AND st.question_number = inc.question_number)
SELECT * FROM f WHERE action <> 'pruned' OR source_document_id IN (SELECT source_document_id FROM inc)
"""


def first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each file and legacy id by line, and how many came again."""
    r = table(spark, d, "legacy_records").where("legacy_chunk_id is not null")
    g = r.groupBy("file_name", "legacy_chunk_id").agg(F.min_by("record_id", F.struct("line_no", "record_id")).alias("record_id"), (F.count("*") - 1).alias("again"))
    return g


FIRST_ARRIVALS = "SELECT file_name, legacy_chunk_id, arg_min(record_id, (line_no, record_id)) AS record_id, count(*) - 1 AS again FROM legacy_records WHERE legacy_chunk_id IS NOT NULL GROUP BY 1, 2"


def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks still to be embedded: without a usable vector of the present model (null-safe comparison), sorted by slug, ordinal and id, the order they are done in."""
    o = table(spark, d, "subject_offerings").select("offering_id", "slug")
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "offering_id", "ordinal")
    v = table(spark, d, "chunk_vectors").where("vector is not null and size(vector) = 128")
    v = v.groupBy("chunk_id").agg(F.max("embedding_model").alias("embedding_model"))
    return c.join(v, "chunk_id", "left").where(~F.col("embedding_model").eqNullSafe(F.lit("leaf-embed-2"))).join(o, "offering_id").select("slug", "chunk_id", "offering_id", "ordinal", "embedding_model").orderBy("slug", "ordinal", "chunk_id")


PENDING_VECTORS = """
WITH v AS (SELECT chunk_id, max(embedding_model) AS embedding_model FROM chunk_vectors WHERE vector IS NOT NULL AND len(vector) = 128 GROUP BY 1)
SELECT o.slug, c.chunk_id, c.offering_id, c.ordinal, v.embedding_model FROM (SELECT DISTINCT chunk_id, offering_id, ordinal FROM chunks) c JOIN subject_offerings o ON o.offering_id = c.offering_id LEFT JOIN v ON v.chunk_id = c.chunk_id WHERE v.embedding_model IS DISTINCT FROM 'leaf-embed-2'
"""


def query_map() -> dict:
    return {
        "last_click": (last_click, LAST_CLICK),
        "pages_of_chunks": (pages_of_chunks, PAGES_OF_CHUNKS),
        "pages_at_offsets": (pages_at_offsets, PAGES_AT_OFFSETS),
        "parse_merge": (parse_merge, PARSE_MERGE),
        "first_arrivals": (first_arrivals, FIRST_ARRIVALS),
        "pending_vectors": (pending_vectors, PENDING_VECTORS),
    }
