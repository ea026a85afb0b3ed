"""Audit, catalogue, inventory, duplicates and consistency of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import uuid5
from inkwell.sources.tables import table

_META = "class string, subject string, chapter_no string, chapter_title string, chapter_name string, page_no string, topic string, prerequisite string, spec_ref string, keywords array<string>, token_count string"


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "legacy_records")
    return r.withColumn("m", F.from_json("meta_json", _META, {"mode": "PERMISSIVE"}))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def index_state(spark: SparkSession, d: str) -> DataFrame:
    """Per offering: distinct chunks, embedded ones, those with raw text, first and last embedding, number of models; 0 where there is nothing."""
    o = table(spark, d, "subject_offerings").select("offering_id", "slug")
    v = table(spark, d, "chunk_vectors").where("vector is not null and size(vector) = 128")
    v = v.groupBy("chunk_id").agg(F.max("embedding_model").alias("model"), F.max("embedded_at").alias("embedded_at"))
    c = _chunks(spark, d).select("chunk_id", "offering_id", "text_raw").join(v, "chunk_id", "left")
    return (
        o.join(c, "offering_id", "left")
        .groupBy("offering_id", "slug")
        .agg(
            F.count("chunk_id").alias("chunks"),
            F.count("model").alias("embedded"),
            F.count_if((F.col("text_raw").isNotNull())).alias("with_raw"),
            F.min("embedded_at").alias("first_embedded"),
            F.max("embedded_at").alias("last_embedded"),
            F.count_distinct("model").alias("models"),
        )
    )


INDEX_STATE = """
WITH v AS (SELECT chunk_id, max(embedding_model) AS model, max(embedded_at) AS embedded_at FROM chunk_vectors
           WHERE vector IS NOT NULL AND len(vector) = 128 GROUP BY chunk_id),
c AS (SELECT DISTINCT chunk_id, offering_id, text_raw FROM chunks)
SELECT o.offering_id, o.slug, count(c.chunk_id) AS chunks, count(v.model) AS embedded, count(*) FILTER (WHERE c.text_raw IS NOT NULL) AS with_raw,
       min(v.embedded_at) AS first_embedded, max(v.embedded_at) AS last_embedded, count(DISTINCT v.model) AS models
FROM subject_offerings o LEFT JOIN c ON c.offering_id = o.offering_id LEFT JOIN v ON v.chunk_id = c.chunk_id GROUP BY o.offering_id, o.slug
"""


def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their document and offering; a chunk without document stays, one without offering doesn't."""
    c = _chunks(spark, d).select("chunk_id", "source_document_id", "offering_id", "chunk_type", "ordinal", "page_number")
    s = table(spark, d, "source_documents").select("source_document_id", "title", "document_type", "source_priority", "paper_code")
    o = table(spark, d, "subject_offerings").select("offering_id", "slug", "curriculum_code", "subject_code", "level_code")
    return c.join(s, "source_document_id", "left").join(o, "offering_id")


RETRIEVAL_CONTEXT = """
SELECT c.offering_id, c.source_document_id, c.chunk_id, c.chunk_type, c.ordinal, c.page_number, s.title, s.document_type, s.source_priority, s.paper_code,
       o.slug, o.curriculum_code, o.subject_code, o.level_code
FROM (SELECT DISTINCT chunk_id, source_document_id, offering_id, chunk_type, ordinal, page_number FROM chunks) c
JOIN subject_offerings o ON o.offering_id = c.offering_id LEFT JOIN source_documents s ON s.source_document_id = c.source_document_id
"""

_RULES = [
    ("blank_text", "text IS NULL OR trim(text) = ''"),
    ("bad_sha256", "content_sha256 IS NULL OR NOT regexp_like(content_sha256, '^[0-9a-f]{64}$')"),
    ("bad_key", "chunk_key IS NULL OR NOT regexp_like(chunk_key, '^[a-z]+:v1:[0-9a-f]{64}:.+$')"),
    ("negative_ordinal", "ordinal < 0"),
    ("pages_out_of_order", "page_number_end < page_number"),
    ("bad_confidence", "extraction_confidence < 0 OR extraction_confidence > 1"),
    ("bad_language", "language IS NULL OR NOT regexp_like(language, '^([a-z]{2}|unknown)$')"),
    ("exam_without_question", "chunk_type = 'exam_question' AND question_number IS NULL"),
    ("legacy_without_id", "chunk_type = 'legacy_record' AND legacy_chunk_id IS NULL"),
    ("uncertain_but_not_ocr", "provenance_status = 'ocr_uncertain' AND extraction_method <> 'ocr_tesseract'"),
    ("changed_without_raw", "provenance_status <> 'verbatim' AND text_raw IS NULL"),
    ("no_token_count", "token_count IS NULL OR token_count <= 0"),
    ("no_sub_parts", "coalesce({size}(sub_parts), 0) = 0 AND chunk_type = 'exam_question'"),
]


def chunk_violations(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that break a rule of the table, with the names of the rules broken, in fixed order."""
    reasons = F.array_compact(F.array(*[F.when(F.expr(rule.replace("{size}", "size")), F.lit(name)) for name, rule in _RULES]))
    rows = _chunks(spark, d).select("chunk_id", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).alias("broken"))
    return rows.where("broken > 0")


CHUNK_VIOLATIONS = (
    "WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks), r AS (SELECT chunk_id, list_filter(["
    + ", ".join(f"CASE WHEN {rule.replace('{size}', 'len').replace('regexp_like', 'regexp_matches')} THEN '{name}' END" for name, rule in _RULES)
    + "], lambda x: x IS NOT NULL) AS reasons FROM c) SELECT chunk_id, array_to_string(reasons, ',') AS reasons, CAST(len(reasons) AS INTEGER) AS broken FROM r WHERE len(reasons) > 0"
)


def same_codes(spark: SparkSession, d: str) -> DataFrame:
    """Syllabus codes that agree when case and hyphens against underscores are ignored, and how many offerings and spellings each has."""
    code = F.upper(F.replace(F.col("syllabus_code"), F.lit("-"), F.lit("_")))
    o = table(spark, d, "subject_offerings").where("syllabus_code is not null")
    return o.groupBy(code.alias("code")).agg(F.count("*").alias("offerings"), F.count_distinct("syllabus_code").alias("spellings"))


SAME_CODES = "SELECT upper(replace(syllabus_code, '-', '_')) AS code, count(*) AS offerings, count(DISTINCT syllabus_code) AS spellings FROM subject_offerings WHERE syllabus_code IS NOT NULL GROUP BY 1"


def latest_reports(spark: SparkSession, d: str) -> DataFrame:
    """The newest report per offering, ties to the higher id, and its rank-one batch by start."""
    r = table(spark, d, "normalisation_reports")
    best = r.groupBy("offering_id").agg(F.max(F.struct("started_at", "report_id", "source_records", "duplicates_seen")).alias("b"))
    return best.select("offering_id", F.col("b.report_id").alias("report_id"), F.col("b.started_at").alias("started_at"), F.col("b.source_records").alias("source_records"), F.col("b.duplicates_seen").alias("duplicates_seen"))


LATEST_REPORTS = "SELECT DISTINCT ON (offering_id) offering_id, report_id, started_at, source_records, duplicates_seen FROM normalisation_reports ORDER BY offering_id, started_at DESC NULLS LAST, report_id DESC"


def latest_batches(spark: SparkSession, d: str) -> DataFrame:
    """All reports of the newest start of each adapter and version, ties kept, rolled up."""
    r = table(spark, d, "normalisation_reports")
    w = Window.partitionBy("adapter", "ingestion_version").orderBy(F.col("started_at").desc_nulls_last())
    rows = r.withColumn("k", F.rank().over(w)).where("k = 1")
    return rows.groupBy("adapter", "ingestion_version").agg(F.max("started_at").alias("started_at"), F.count("*").alias("reports"), F.sum("source_records").alias("records"))


LATEST_BATCHES = """
SELECT adapter, ingestion_version, max(started_at) AS started_at, count(*) AS reports, CAST(sum(source_records) AS BIGINT) AS records FROM (
  SELECT *, rank() OVER (PARTITION BY adapter, ingestion_version ORDER BY started_at DESC NULLS LAST) AS k FROM normalisation_reports) WHERE k = 1 GROUP BY 1, 2
"""


def report_groups(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups as the reports recorded them: groups and locators per report, unfinished runs told apart."""
    r = table(spark, d, "normalisation_reports")
    sizes = F.aggregate(F.map_values("duplicate_content_groups"), F.lit(0), lambda s, x: s + F.size(x))
    return r.select("report_id", F.coalesce(F.size(F.map_keys("duplicate_content_groups")), F.lit(0)).alias("groups"), F.coalesce(sizes, F.lit(0)).alias("locators"), F.col("finished_at").isNull().alias("unfinished"))


REPORT_GROUPS = """
SELECT report_id, CAST(coalesce(cardinality(duplicate_content_groups), 0) AS INTEGER) AS groups,
       CAST(coalesce(list_sum(list_transform(map_values(duplicate_content_groups), lambda x: len(x))), 0) AS INTEGER) AS locators, finished_at IS NULL AS unfinished FROM normalisation_reports
"""


def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per subject: files, records, classes, chapters, records with Bengali, missing fields, and least, middle and most characters and declared tokens."""
    r = _records(spark, d).where("content is not null")
    subject = F.coalesce(F.nullif(F.lower(F.trim("m.subject")), F.lit("")), F.lit("unknown"))
    tokens = F.col("m.token_count").try_cast("int")
    missing = [F.count_if(F.col(f"m.{f}").isNull()).alias(f"no_{f}") for f in ("prerequisite", "spec_ref", "keywords")]
    return r.groupBy(subject.alias("subject")).agg(
        F.count_distinct("file_name").alias("files"),
        F.count("*").alias("records"),
        F.count_distinct("m.class").alias("classes"),
        F.count_distinct("m.chapter_no").alias("chapters"),
        F.count_if(F.col("content").rlike("[\\u0980-\\u09FF]")).alias("with_bengali"),
        *missing,
        F.min(F.length("content")).alias("least_chars"),
        F.median(F.length("content")).alias("middle_chars"),
        F.max(F.length("content")).alias("most_chars"),
        F.min(tokens).alias("least_tokens"),
        F.median(tokens).alias("middle_tokens"),
        F.max(tokens).alias("most_tokens"),
    )


_J = "json_extract_string(m, '$.{}')"
CORPUS_AUDIT = f"""
WITH r AS (SELECT *, CASE WHEN json_valid(meta_json) THEN meta_json END AS m FROM legacy_records WHERE content IS NOT NULL)
SELECT coalesce(nullif(lower(trim({_J.format('subject')})), ''), 'unknown') AS subject, count(DISTINCT file_name) AS files, count(*) AS records,
  count(DISTINCT {_J.format('class')}) AS classes, count(DISTINCT {_J.format('chapter_no')}) AS chapters,
  count(*) FILTER (WHERE regexp_matches(content, '[\\x{{0980}}-\\x{{09FF}}]')) AS with_bengali,
  count(*) FILTER (WHERE {_J.format('prerequisite')} IS NULL) AS no_prerequisite, count(*) FILTER (WHERE {_J.format('spec_ref')} IS NULL) AS no_spec_ref,
  count(*) FILTER (WHERE {_J.format('keywords')} IS NULL) AS no_keywords,
  CAST(min(length(content)) AS INTEGER) AS least_chars, median(length(content)) AS middle_chars, CAST(max(length(content)) AS INTEGER) AS most_chars,
  min(TRY_CAST({_J.format('token_count')} AS INTEGER)) AS least_tokens, median(TRY_CAST({_J.format('token_count')} AS INTEGER)) AS middle_tokens,
  max(TRY_CAST({_J.format('token_count')} AS INTEGER)) AS most_tokens
FROM r GROUP BY 1
"""


def file_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per file: records, characters, and the sorted subjects."""
    r = _records(spark, d)
    subjects = F.array_join(F.array_sort(F.collect_set(F.trim("m.subject"))), "|")
    return r.groupBy("file_name").agg(F.count("*").alias("records"), F.sum(F.length("content")).alias("chars"), subjects.alias("subjects"))


FILE_ROLLUP = f"""
WITH r AS (SELECT *, CASE WHEN json_valid(meta_json) THEN meta_json END AS m FROM legacy_records)
SELECT file_name, count(*) AS records, CAST(sum(length(content)) AS BIGINT) AS chars,
  coalesce(array_to_string(list_sort(list(DISTINCT trim({_J.format('subject')})) FILTER (WHERE {_J.format('subject')} IS NOT NULL)), '|'), '') AS subjects FROM r GROUP BY file_name
"""


def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of records with equal trimmed lower-case content: size, files, and the first and last locator."""
    r = table(spark, d, "legacy_records").withColumn("t", F.lower(F.regexp_replace("content", "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", ""))).where("t <> ''")
    where = F.concat_ws("#", "file_name", F.coalesce("legacy_chunk_id", F.lit("?")))
    groups = r.groupBy(F.sha2(F.encode("t", "utf-8"), 256).alias("sha256"))
    g = groups.agg(F.count("*").alias("records"), F.count_distinct("file_name").alias("files"), F.min(where).alias("first_locator"), F.max(where).alias("last_locator"))
    return g.where("records > 1")


CONTENT_DUPLICATES = """
WITH r AS (SELECT *, lower(regexp_replace(content, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) AS t FROM legacy_records)
SELECT sha256(t) AS sha256, count(*) AS records, count(DISTINCT file_name) AS files,
  min(file_name || '#' || coalesce(legacy_chunk_id, '?')) AS first_locator, max(file_name || '#' || coalesce(legacy_chunk_id, '?')) AS last_locator FROM r WHERE t <> '' GROUP BY 1 HAVING count(*) > 1
"""


def repeated(df: DataFrame, column: str) -> DataFrame:
    """column, records: the values that several rows have."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("records")).where("records > 1")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return repeated(table(spark, d, "legacy_records"), "legacy_chunk_id")


DUPLICATE_IDS = "SELECT legacy_chunk_id, count(*) AS records FROM legacy_records WHERE legacy_chunk_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"

_ARTEFACTS = [
    ("split_word", "[A-Za-z]{2,}- [A-Za-z]{2,}"),
    ("double_blank", "[^ ]  +[^ ]"),
    ("no_break_space", "\\x{00A0}"),
    ("zero_width", "[\\x{200B}\\x{2060}\\x{FEFF}]"),
    ("full_width", "[\\x{FF01}-\\x{FF5E}]"),
]


def artefacts(spark: SparkSession, d: str) -> DataFrame:
    """How many records show each artefact, and the first of them."""
    r = table(spark, d, "legacy_records")
    pairs = F.array(*[F.struct(F.lit(n).alias("artefact"), F.col("content").rlike(p).alias("hit")) for n, p in _ARTEFACTS])
    rows = r.select("record_id", F.explode(pairs).alias("a")).where("a.hit")
    return rows.groupBy(F.col("a.artefact").alias("artefact")).agg(F.count("*").alias("records"), F.min("record_id").alias("first_record"))


ARTEFACTS = " UNION ALL ".join(
    f"SELECT '{n}' AS artefact, count(*) AS records, min(record_id) AS first_record FROM legacy_records WHERE regexp_matches(content, '{p}') HAVING count(*) > 0" for n, p in _ARTEFACTS
)


# Traces of bad scans and extractions, with the pattern of each.
ARTEFACT_HITS_OF = [
    ("bangla_duplicated_vowel_sign", "যয|োো|িি"),
    ("bullet_ocr_as_letter_e", "(?:^|\\n){WS}*e{WS}+[A-Z]"),
    ("stray_control_chars", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"),
    ("repeated_whitespace_run", " {4,}"),
    ("broken_word_split", "[\\p{L}\\p{N}_]-{WS}+[\\p{L}\\p{N}_]"),
]
_SPACE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def artefact_hits(spark: SparkSession, d: str) -> DataFrame:
    """Records that show each trace of a bad scan, where the first one stands, and the place of the trace by records, most first."""
    r = table(spark, d, "legacy_records")
    pairs = F.array(*[F.struct(F.lit(n).alias("artefact"), F.col("content").rlike(p.replace("{WS}", _SPACE)).alias("hit")) for n, p in ARTEFACT_HITS_OF])
    rows = r.select("file_name", "line_no", F.explode(pairs).alias("a")).where("a.hit")
    each = rows.groupBy(F.col("a.artefact").alias("artefact")).agg(F.count("*").alias("records"), F.min(F.struct("file_name", "line_no")).alias("f"))
    w = Window.orderBy(F.desc("records"), "artefact")  # five rows at most
    return each.select("artefact", "records", F.concat_ws(":", "f.file_name", "f.line_no").alias("first"), F.row_number().over(w).alias("place"))


ARTEFACT_HITS = (
    "WITH h AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS artefact, count(*) AS records, min({{'f': file_name, 'l': line_no}}) AS f FROM legacy_records WHERE regexp_matches(content, '{p.replace('{WS}', _SPACE)}') HAVING count(*) > 0"
        for n, p in ARTEFACT_HITS_OF
    )
    + ") SELECT artefact, records, f.f || ':' || f.l AS first, CAST(row_number() OVER (ORDER BY records DESC, artefact) AS INTEGER) AS place FROM h"
)


def repeated_cut_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that an export which cut off their last character would repeat."""
    r = table(spark, d, "legacy_records").where("legacy_chunk_id is not null")
    cut = r.select(F.expr("left(legacy_chunk_id, length(legacy_chunk_id) - 1)").alias("legacy_chunk_id"))
    return repeated(cut, "legacy_chunk_id")


REPEATED_CUT_IDS = "SELECT left(legacy_chunk_id, length(legacy_chunk_id) - 1) AS legacy_chunk_id, count(*) AS records FROM legacy_records WHERE legacy_chunk_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Documents by type and route: number, bytes, pages, private ones, distinct checksums; a missing size counts nothing."""
    s = table(spark, d, "source_documents")
    return s.groupBy("document_type", "ingestion_route").agg(
        F.count("*").alias("documents"),
        F.sum("bytes").alias("bytes"),
        F.sum("page_count").alias("pages"),
        F.count_if("is_private").alias("private"),
        F.count_distinct("sha256").alias("checksums"),
    )


CATALOGUE = """
SELECT document_type, ingestion_route, count(*) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(page_count) AS BIGINT) AS pages,
  count(*) FILTER (WHERE is_private) AS private, count(DISTINCT sha256) AS checksums FROM source_documents GROUP BY 1, 2
"""


def repeated_papers(spark: SparkSession, d: str) -> DataFrame:
    """Titles and paper codes carried by several documents."""
    s = table(spark, d, "source_documents")
    pairs = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("paper_code").alias("field"), F.col("paper_code").alias("value"))))
    rows = s.select("source_document_id", pairs.alias("p")).where("p.value is not null")
    return rows.groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("documents")).where("documents > 1")


REPEATED_PAPERS = """
SELECT 'title' AS field, title AS value, count(*) AS documents FROM source_documents WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1
UNION ALL SELECT 'paper_code', paper_code, count(*) FROM source_documents WHERE paper_code IS NOT NULL GROUP BY paper_code HAVING count(*) > 1
"""


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by offering, type, method and provenance with the rounded mean of the recorded tokens."""
    c = _chunks(spark, d)
    return c.groupBy("offering_id", "chunk_type", "extraction_method", "provenance_status").agg(F.count("*").alias("chunks"), F.round(F.avg("token_count")).cast("long").alias("mean_tokens"), F.sum("marks").alias("marks"))


INVENTORY = """
SELECT offering_id, chunk_type, extraction_method, provenance_status, count(*) AS chunks, CAST(round(avg(token_count)) AS BIGINT) AS mean_tokens, CAST(sum(marks) AS BIGINT) AS marks
FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) GROUP BY 1, 2, 3, 4
"""


def recorded_counts(spark: SparkSession, d: str) -> DataFrame:
    """Offerings whose recorded number of chunks isn't the number there is (null-safe)."""
    o = table(spark, d, "subject_offerings").select("offering_id", "indexed_chunk_count")
    n = _chunks(spark, d).groupBy("offering_id").agg(F.count("*").alias("chunks"))
    rows = o.join(n, "offering_id", "left").select("offering_id", "indexed_chunk_count", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return rows.where(~F.col("indexed_chunk_count").cast("long").eqNullSafe(F.col("chunks")))


RECORDED_COUNTS = """
WITH n AS (SELECT offering_id, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY 1)
SELECT o.offering_id, o.indexed_chunk_count, coalesce(n.chunks, 0) AS chunks FROM subject_offerings o LEFT JOIN n ON n.offering_id = o.offering_id
WHERE o.indexed_chunk_count IS DISTINCT FROM coalesce(n.chunks, 0)
"""


def _misplaced(c: DataFrame, s: DataFrame) -> DataFrame:
    s = s.select("source_document_id", F.col("offering_id").alias("own"), "sha256")
    rows = c.join(s, "source_document_id", "left")
    kind = F.when(F.col("own").isNull() & F.col("sha256").isNull(), "no_document").when(F.col("own") != F.col("offering_id"), "other_offering").when(F.instr("chunk_key", F.col("sha256")) == 0, "other_checksum")
    return rows.select("chunk_id", kind.alias("problem")).where("problem is not null")


def misplaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose offering isn't their document's, whose key lacks the document's checksum, or whose document is gone."""
    c = _chunks(spark, d).select("chunk_id", "chunk_key", "offering_id", "source_document_id")
    return _misplaced(c, table(spark, d, "source_documents"))


def misplaced_after_damage(spark: SparkSession, d: str) -> DataFrame:
    """The same after a bad load: documents that were scanned are gone, exam questions moved to another offering, and keys of specification points lost their checksum."""
    c = _chunks(spark, d)
    moved = F.when(F.col("chunk_type") == "exam_question", F.reverse("offering_id")).otherwise(F.col("offering_id"))
    key = F.when(F.col("chunk_type") == "specification_point", F.regexp_replace("chunk_key", "[0-9a-f]{64}", "")).otherwise(F.col("chunk_key"))
    c = c.select("chunk_id", key.alias("chunk_key"), moved.alias("offering_id"), "source_document_id")
    return _misplaced(c, table(spark, d, "source_documents").where("coalesce(ingestion_route, '') <> 'ocr'"))


MISPLACED_AFTER_DAMAGE = """
SELECT chunk_id, problem FROM (SELECT c.chunk_id, CASE WHEN s.offering_id IS NULL AND s.sha256 IS NULL THEN 'no_document' WHEN s.offering_id <> c.offering_id THEN 'other_offering'
  WHEN instr(c.chunk_key, s.sha256) = 0 THEN 'other_checksum' END AS problem
  FROM (SELECT DISTINCT chunk_id, CASE WHEN chunk_type = 'specification_point' THEN regexp_replace(chunk_key, '[0-9a-f]{64}', '', 'g') ELSE chunk_key END AS chunk_key,
    CASE WHEN chunk_type = 'exam_question' THEN reverse(offering_id) ELSE offering_id END AS offering_id, source_document_id FROM chunks) c
  LEFT JOIN (SELECT * FROM source_documents WHERE coalesce(ingestion_route, '') <> 'ocr') s ON s.source_document_id = c.source_document_id) WHERE problem IS NOT NULL
"""


MISPLACED_CHUNKS = """
SELECT chunk_id, problem FROM (SELECT c.chunk_id, CASE WHEN s.offering_id IS NULL AND s.sha256 IS NULL THEN 'no_document' WHEN s.offering_id <> c.offering_id THEN 'other_offering'
  WHEN instr(c.chunk_key, s.sha256) = 0 THEN 'other_checksum' END AS problem
  FROM (SELECT DISTINCT chunk_id, chunk_key, offering_id, source_document_id FROM chunks) c LEFT JOIN source_documents s ON s.source_document_id = c.source_document_id) WHERE problem IS NOT NULL
"""


def large_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Offerings with chunks of more than 600 recorded tokens: how many, and the most."""
    c = _chunks(spark, d).where("token_count > 600")
    return c.groupBy("offering_id").agg(F.count("*").alias("chunks"), F.max("token_count").alias("most_tokens"))


LARGE_CHUNKS = "SELECT offering_id, count(DISTINCT chunk_id) AS chunks, max(token_count) AS most_tokens FROM chunks WHERE token_count > 600 GROUP BY 1"


def _missing(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.select("file_name").join(s.select(F.col("filename").alias("file_name")), "file_name", "left_anti").groupBy("file_name").agg(F.count("*").alias("records"))


def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files of legacy records that no source document carries, by file (an anti join)."""
    return _missing(table(spark, d, "legacy_records"), table(spark, d, "source_documents"))


def missing_after_loss(spark: SparkSession, d: str) -> DataFrame:
    """The same after a loss in which only documents of a known size of at least 300,000 bytes were saved."""
    return _missing(table(spark, d, "legacy_records"), table(spark, d, "source_documents").where("bytes >= 300000"))


MISSING_AFTER_LOSS = "SELECT file_name, count(*) AS records FROM legacy_records r WHERE NOT EXISTS (SELECT 1 FROM source_documents s WHERE s.filename = r.file_name AND s.bytes >= 300000) GROUP BY 1"
MISSING_DOCUMENTS = "SELECT file_name, count(*) AS records FROM legacy_records r WHERE NOT EXISTS (SELECT 1 FROM source_documents s WHERE s.filename = r.file_name) GROUP BY 1"

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    """The name-based UUID of each chunk key, and whether it is the chunk's id."""
    c = _chunks(spark, d).where("chunk_key is not null")
    own = uuid5(NAMESPACE, F.col("chunk_key"))
    return c.select("chunk_key", own.alias("own_id"), (own == F.col("chunk_id")).alias("same"))


CHUNK_IDENTITY = f"""
WITH c AS (SELECT DISTINCT chunk_id, chunk_key FROM chunks WHERE chunk_key IS NOT NULL),
h AS (SELECT *, sha1(from_hex('{NAMESPACE.replace('-', '')}') || encode(chunk_key)) AS h FROM c),
u AS (SELECT chunk_id, chunk_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS own_id FROM h)
SELECT chunk_key, own_id, own_id = chunk_id AS same FROM u
"""


def priority_order(spark: SparkSession, d: str) -> DataFrame:
    """The three documents of most authority in each offering: by priority, type in its declared order, paper code (none last), file name."""
    s = table(spark, d, "source_documents")
    w = Window.partitionBy("offering_id").orderBy(F.col("source_priority").asc_nulls_last(), _type_rank(), F.col("paper_code").asc_nulls_last(), F.col("filename").asc_nulls_last(), "source_document_id")
    return s.select("source_document_id", "offering_id", F.row_number().over(w).alias("place")).where("place <= 3")


TYPE_ORDER = ["specification", "past_paper", "mark_scheme", "examiner_report", "textbook", "legacy_corpus", "topic_notes"]


def _type_rank():
    c = F.lit(99)
    for k, name in reversed(list(enumerate(TYPE_ORDER))):
        c = F.when(F.col("document_type") == name, k).otherwise(c)
    return c


PRIORITY_ORDER = f"""
SELECT * FROM (SELECT source_document_id, offering_id, CAST(row_number() OVER (PARTITION BY offering_id ORDER BY source_priority ASC NULLS LAST,
  CASE {' '.join(f"WHEN document_type = '{n}' THEN {k}" for k, n in enumerate(TYPE_ORDER))} ELSE 99 END, paper_code ASC NULLS LAST, filename ASC NULLS LAST, source_document_id) AS INTEGER) AS place FROM source_documents) WHERE place <= 3
"""


def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages per document: how many, mean confidence of their words (a page counts with its words), words, and pages under the floor of 70."""
    p = table(spark, d, "ocr_pages").withColumn("w", F.when(F.col("confidence").isNotNull(), F.col("words")))
    mean = F.coalesce(F.sum(F.col("confidence") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0)), F.lit(0.0))
    return p.groupBy("source_document_id").agg(F.count("*").alias("pages"), F.round(mean, 4).alias("confidence"), F.sum("words").alias("words"), F.count_if(F.col("confidence") < 70).alias("uncertain"))


OCR_QUALITY = "SELECT source_document_id, count(*) AS pages, round(coalesce(sum(confidence * words) / nullif(sum(words) FILTER (WHERE confidence IS NOT NULL), 0), 0.0), 4) AS confidence, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (WHERE confidence < 70) AS uncertain FROM ocr_pages GROUP BY 1"


def facets(spark: SparkSession, d: str) -> DataFrame:
    """Curriculum, level and subject facets with their offerings, documents and chunks; a facet without documents shows 0."""
    o = table(spark, d, "subject_offerings").select("offering_id", "curriculum_code", "level_code", "subject_code")
    s = table(spark, d, "source_documents").groupBy("offering_id").agg(F.count("*").alias("documents"))
    c = _chunks(spark, d).groupBy("offering_id").agg(F.count("*").alias("chunks"))
    rows = o.join(s, "offering_id", "left").join(c, "offering_id", "left")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    return rows.groupBy("curriculum_code", "level_code", "subject_code").agg(F.count("*").alias("offerings"), zero("documents"), zero("chunks"))


FACETS = """
WITH s AS (SELECT offering_id, count(*) AS documents FROM source_documents GROUP BY 1), c AS (SELECT offering_id, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY 1)
SELECT curriculum_code, level_code, subject_code, count(*) AS offerings, CAST(coalesce(sum(documents), 0) AS BIGINT) AS documents, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks
FROM subject_offerings o LEFT JOIN s ON s.offering_id = o.offering_id LEFT JOIN c ON c.offering_id = o.offering_id GROUP BY 1, 2, 3
"""


def report_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """For each report whether its number of records is that of the document's records."""
    r = table(spark, d, "normalisation_reports").select("report_id", "source_document_id", "source_records")
    n = table(spark, d, "legacy_records").groupBy("source_document_id").agg(F.count("*").alias("there"))
    rows = r.join(n, "source_document_id", "left").select("report_id", "source_records", F.coalesce("there", F.lit(0)).alias("there"))
    differs = ~F.col("source_records").cast("long").eqNullSafe(F.col("there"))
    return rows.withColumn("state", F.when(F.col("there") == 0, "no_records").when(differs, "other_number").otherwise("ok"))


REPORT_RECONCILIATION = """
WITH n AS (SELECT source_document_id, count(*) AS there FROM legacy_records GROUP BY 1), r AS (SELECT report_id, source_records, coalesce(n.there, 0) AS there FROM normalisation_reports p LEFT JOIN n ON n.source_document_id = p.source_document_id)
SELECT *, CASE WHEN there = 0 THEN 'no_records' WHEN source_records IS DISTINCT FROM there THEN 'other_number' ELSE 'ok' END AS state FROM r
"""


def language_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Offerings (a fixed table of 40) that a document could serve: those of its own, or any that lists its language; documents by offering."""
    o = table(spark, d, "subject_offerings").select("offering_id", "languages")
    s = table(spark, d, "source_documents").select(F.col("offering_id").alias("own"), "declared_language")
    s = s.groupBy("own", "declared_language").agg(F.count("*").alias("n"))  # at most offerings x labels rows before the theta join
    met = o.join(s, (F.col("own") == F.col("offering_id")) | F.expr("array_contains(languages, declared_language)"))
    return met.groupBy("offering_id").agg(F.sum("n").alias("documents"), F.sum(F.when(F.col("own") == F.col("offering_id"), F.col("n")).otherwise(0)).alias("own_documents"))


LANGUAGE_COVERAGE = """
SELECT o.offering_id, count(*) AS documents, count(*) FILTER (WHERE s.offering_id = o.offering_id) AS own_documents
FROM subject_offerings o JOIN source_documents s ON s.offering_id = o.offering_id OR list_contains(o.languages, s.declared_language) GROUP BY 1
"""


def sub_part_totals(spark: SparkSession, d: str) -> DataFrame:
    """Questions with sub-parts: their marks, the sum of the parts' marks, and whether both agree."""
    q = table(spark, d, "parsed_questions").where("marks is not null and size(sub_parts) > 0")
    total = F.aggregate("sub_parts", F.lit(0), lambda s, x: s + F.coalesce(x["marks"], F.lit(0)))
    return q.select("question_id", "marks", F.size("sub_parts").alias("parts"), total.alias("part_marks"), (F.col("marks") == total).alias("agree"))


SUB_PART_TOTALS = """
SELECT *, marks = part_marks AS agree FROM (SELECT question_id, marks, CAST(len(sub_parts) AS INTEGER) AS parts, CAST(list_sum(list_transform(sub_parts, lambda x: coalesce(x.marks, 0))) AS INTEGER) AS part_marks
  FROM parsed_questions WHERE marks IS NOT NULL AND len(sub_parts) > 0)
"""


def query_map() -> dict:
    named = {
        "index_state": (index_state, INDEX_STATE),
        "retrieval_context": (retrieval_context, RETRIEVAL_CONTEXT),
        "chunk_violations": (chunk_violations, CHUNK_VIOLATIONS),
        "same_codes": (same_codes, SAME_CODES),
        "latest_reports": (latest_reports, LATEST_REPORTS),
        "latest_batches": (latest_batches, LATEST_BATCHES),
        "report_groups": (report_groups, REPORT_GROUPS),
        "corpus_audit": (corpus_audit, CORPUS_AUDIT),
        "file_rollup": (file_rollup, FILE_ROLLUP),
        "content_duplicates": (content_duplicates, CONTENT_DUPLICATES),
        "duplicate_ids": (duplicate_ids, DUPLICATE_IDS),
        "artefacts": (artefacts, ARTEFACTS),
        "artefact_hits": (artefact_hits, ARTEFACT_HITS),
        "repeated_cut_ids": (repeated_cut_ids, REPEATED_CUT_IDS),
        "misplaced_after_damage": (misplaced_after_damage, MISPLACED_AFTER_DAMAGE),
        "missing_after_loss": (missing_after_loss, MISSING_AFTER_LOSS),
        "catalogue": (catalogue, CATALOGUE),
        "repeated_papers": (repeated_papers, REPEATED_PAPERS),
        "inventory": (inventory, INVENTORY),
        "recorded_counts": (recorded_counts, RECORDED_COUNTS),
        "misplaced_chunks": (misplaced_chunks, MISPLACED_CHUNKS),
        "large_chunks": (large_chunks, LARGE_CHUNKS),
        "missing_documents": (missing_documents, MISSING_DOCUMENTS),
        "chunk_identity": (chunk_identity, CHUNK_IDENTITY),
        "priority_order": (priority_order, PRIORITY_ORDER),
        "ocr_quality": (ocr_quality, OCR_QUALITY),
        "facets": (facets, FACETS),
        "report_reconciliation": (report_reconciliation, REPORT_RECONCILIATION),
        "language_coverage": (language_coverage, LANGUAGE_COVERAGE),
        "sub_part_totals": (sub_part_totals, SUB_PART_TOTALS),
    }
    return named
