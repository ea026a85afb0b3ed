"""Catalogue of files and documents: reconciliation, what paths tell, evidence, text layers, merges, citations and field gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import paths as H
from inkwell.functions import text as X
from inkwell.operators import answers, merge
from inkwell.operators import tables as T
from inkwell.plans.flow import _KEYS, _PARSES, _two_parses
from inkwell.sources.files import layer_verdict
from inkwell.sources.tables import table


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue as a second walk over the files might find it: of the documents with sizes, some with a page more, another route, or another checksum."""
    s = table(spark, d, "source_documents").where("sha256 is not null and bytes is not null")
    sha = F.when(F.col("bytes") % 13 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))
    pages = F.when(F.col("bytes") % 11 == 0, F.col("page_count") + 1).otherwise(F.col("page_count"))
    verdict = F.when(F.col("bytes") % 7 == 0, "mixed").otherwise(F.col("ingestion_route"))
    return s.select("source_document_id", sha.alias("sha256"), pages.alias("pages"), verdict.alias("verdict"))


_OBSERVED = """ob AS (SELECT source_document_id, CASE WHEN bytes % 13 = 0 THEN reverse(sha256) ELSE sha256 END AS sha256, CASE WHEN bytes % 11 = 0 THEN page_count + 1 ELSE page_count END AS pages,
  CASE WHEN bytes % 7 = 0 THEN 'mixed' ELSE ingestion_route END AS verdict FROM source_documents WHERE sha256 IS NOT NULL AND bytes IS NOT NULL)"""


def catalogue_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Private documents whose checksum, pages or route the catalogue doesn't bear out."""
    docs = table(spark, d, "source_documents").where("is_private").select("source_document_id", "sha256", "page_count", "ingestion_route")
    return T.catalogue_mismatches(docs, _observed(spark, d))


CATALOGUE_MISMATCHES = f"""
WITH {_OBSERVED}, c AS (SELECT sha256, min({{'pages': pages, 'verdict': verdict}}) AS c FROM ob GROUP BY 1),
r AS (SELECT s.source_document_id, s.page_count, s.ingestion_route, c.sha256 AS found, c.c.pages AS pages, c.c.verdict AS verdict FROM source_documents s LEFT JOIN c ON c.sha256 = s.sha256 WHERE s.is_private AND s.sha256 IS NOT NULL)
SELECT source_document_id, 'not_in_catalogue' AS problem FROM r WHERE found IS NULL
UNION ALL SELECT source_document_id, 'other_pages' FROM r WHERE found IS NOT NULL AND page_count IS NOT NULL AND pages IS DISTINCT FROM page_count
UNION ALL SELECT source_document_id, 'other_route' FROM r WHERE found IS NOT NULL AND verdict IS NOT NULL AND verdict IS DISTINCT FROM ingestion_route
"""


def checksum_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose checksum the second walk corrects."""
    docs = table(spark, d, "source_documents").select("source_document_id", "sha256")
    return T.backfilled(docs, _observed(spark, d), ["source_document_id"], "sha256").where("changed").drop("changed")


CHECKSUM_BACKFILL = f"WITH {_OBSERVED} SELECT s.source_document_id, ob.sha256 FROM source_documents s JOIN ob ON ob.source_document_id = s.source_document_id WHERE ob.sha256 IS DISTINCT FROM s.sha256"

_FOLDER_OF = {"past_paper": "Question-Paper", "mark_scheme": "mark-scheme", "examiner_report": "examiner-report", "specification": "specification", "textbook": "textbooks", "revision_guide": "revision-guide", "topic_notes": "topic-notes"}


def _with_path(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the path a tidy archive gives them: subject, type, session, file; every fifth only has a mark in its name."""
    s = table(spark, d, "source_documents").where("filename is not null")
    subject = F.split("filename", "_")[0]
    folder = F.element_at(F.create_map(*[F.lit(x) for kv in _FOLDER_OF.items() for x in kv]), F.col("document_type"))
    when = F.concat_ws(" ", F.col("session_year").cast("string"), "session_series")
    marked = F.concat_ws("/", subject, F.concat(F.lit("x-"), F.when(F.col("document_type") == "past_paper", "que").when(F.col("document_type") == "mark_scheme", "rms").otherwise("pef"), F.lit("-"), "filename"))
    tidy = F.concat_ws("/", subject, folder, F.when(F.col("session_year").isNotNull() & F.col("session_series").isNotNull(), when), "filename")
    return s.withColumn("path", F.when(F.col("page_count") % 5 == 0, marked).otherwise(tidy))


_WITH_PATH = f"""wp AS (SELECT *, CASE WHEN page_count % 5 = 0 THEN split_part(filename, '_', 1) || '/x-' || CASE document_type WHEN 'past_paper' THEN 'que' WHEN 'mark_scheme' THEN 'rms' ELSE 'pef' END || '-' || filename
  ELSE concat_ws('/', split_part(filename, '_', 1), CASE document_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _FOLDER_OF.items())} END, CASE WHEN session_year IS NOT NULL AND session_series IS NOT NULL THEN session_year || ' ' || session_series END, filename) END AS path
  FROM source_documents WHERE filename IS NOT NULL)"""


def classified_paths(spark: SparkSession, d: str) -> DataFrame:
    """What the paths of the documents say: subject, type, priority and session."""
    p = F.col("path")
    year, series = H.session(p)
    return _with_path(spark, d).select("source_document_id", "path", H.subject_folder(p).alias("subject"), H.document_type(p).alias("kind"), H.source_priority(p).alias("priority"), year.alias("year"), series.alias("series"))


CLASSIFIED_PATHS = f"""
WITH {_WITH_PATH}, f AS (SELECT source_document_id, path, string_split(path, '/') AS parts, lower(regexp_replace(list_last(string_split(path, '/')), '(.)\\.[^.]*$', '\\1')) AS stem FROM wp),
g AS (SELECT *, list_filter(parts, lambda x: lower(x) IN ({', '.join(f"'{k}'" for k in H.FOLDER_TYPES)}))[1] AS folder, list_filter(parts, lambda x: regexp_matches(x, '^\\d{{4}}\\s+.+$'))[1] AS named FROM f),
k AS (SELECT *, CASE lower(folder) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, (v, _) in H.FOLDER_TYPES.items())} END AS by_folder, CASE {' '.join(f"WHEN regexp_matches(stem, '-{m}(-|$)') THEN '{t}'" for m, t in H.NAME_TYPES.items())} END AS by_name FROM g)
SELECT source_document_id, path, CASE WHEN contains(path, '/') THEN parts[1] END AS subject, coalesce(by_folder, by_name, 'unknown') AS kind,
  CAST(coalesce(CASE lower(folder) {' '.join(f"WHEN '{k}' THEN {v}" for k, (_, v) in H.FOLDER_TYPES.items())} END, CASE WHEN by_name IS NOT NULL THEN 1 END) AS INTEGER) AS priority,
  CAST(regexp_extract(named, '^(\\d{{4}})\\s+(.+)$', 1) AS INTEGER) AS year, trim(regexp_extract(named, '^(\\d{{4}})\\s+(.+)$', 2)) AS series FROM k
"""


def built_titles(spark: SparkSession, d: str) -> DataFrame:
    """A title for every document of a paper, from its type, code, unit and session."""
    s = table(spark, d, "source_documents").where("paper_code is not null")
    title = H.title_of(F.col("document_type"), F.col("paper_code"), F.col("unit_number"), F.col("session_year"), F.col("session_series"))
    return s.select("source_document_id", title.alias("title"))


BUILT_TITLES = f"""SELECT source_document_id, trim(coalesce(CASE document_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in H.TYPE_LABELS.items())} END, document_type, 'Document') || ' — ' ||
  concat_ws(' ', paper_code, 'Unit ' || unit_number, session_year, session_series)) AS title FROM source_documents WHERE paper_code IS NOT NULL"""


def paper_groups(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each paper code together, in the order of their types: how many, pages, and the list."""
    from inkwell.plans.corpus import _type_rank

    s = table(spark, d, "source_documents")
    g = s.groupBy(F.coalesce("paper_code", F.lit("Other")).alias("paper")).agg(
        F.count("*").alias("documents"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"),
        F.array_sort(F.collect_set(F.struct(_type_rank().alias("r"), F.col("document_type")))).alias("types"),
    )
    return g.select("paper", "documents", "pages", F.array_join(F.transform("types", lambda x: x["document_type"]), ",").alias("types"))


def _paper_groups_sql() -> str:
    from inkwell.plans.corpus import TYPE_ORDER

    rank = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(TYPE_ORDER))
    return f"""WITH t AS (SELECT coalesce(paper_code, 'Other') AS paper, page_count, document_type, CASE document_type {rank} ELSE 99 END AS r FROM source_documents),
    u AS (SELECT paper, string_agg(document_type, ',' ORDER BY r, document_type) AS types FROM (SELECT DISTINCT paper, document_type, r FROM t) GROUP BY 1)
    SELECT t.paper, count(*) AS documents, CAST(sum(coalesce(page_count, 0)) AS BIGINT) AS pages, any_value(u.types) AS types FROM t JOIN u ON u.paper = t.paper GROUP BY 1"""


def offering_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What each offering has: documents, chunks, scanned pages; and what is missing, in fixed order."""
    o = table(spark, d, "subject_offerings").select("offering_id", "slug")
    s = table(spark, d, "source_documents").select("offering_id", "source_document_id")
    pages = table(spark, d, "ocr_pages").select("source_document_id").distinct().join(s, "source_document_id")
    rows = T.has_any(o, s, ["offering_id"], "documents")
    rows = T.has_any(rows, table(spark, d, "chunks"), ["offering_id"], "chunks")
    rows = T.has_any(rows, pages, ["offering_id"], "scans")
    missing = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(f"no_{c}")) for c in ("documents", "chunks", "scans")]))
    return rows.withColumn("missing", F.array_join(missing, ","))


OFFERING_EVIDENCE = """
WITH e AS (SELECT offering_id, slug, EXISTS (SELECT 1 FROM source_documents s WHERE s.offering_id = o.offering_id) AS documents, EXISTS (SELECT 1 FROM chunks c WHERE c.offering_id = o.offering_id) AS chunks,
  EXISTS (SELECT 1 FROM ocr_pages p JOIN source_documents s ON s.source_document_id = p.source_document_id WHERE s.offering_id = o.offering_id) AS scans FROM subject_offerings o)
SELECT *, array_to_string(list_filter([CASE WHEN NOT documents THEN 'no_documents' END, CASE WHEN NOT chunks THEN 'no_chunks' END, CASE WHEN NOT scans THEN 'no_scans' END], lambda x: x IS NOT NULL), ',') AS missing FROM e
"""


def _layer_pages(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages as a text layer: of pages read badly nothing is left, or marks of glyphs without letters."""
    p = table(spark, d, "ocr_pages").where("source_document_id is not null")
    text = F.when(F.col("confidence") < 75, "").when(F.col("confidence") < 82, F.regexp_replace("text", "[aeiouা]", "(cid:7)")).otherwise(F.col("text"))
    return p.select("source_document_id", "page_number", "page_id", text.alias("text"))


def layer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return layer_verdict(_layer_pages(spark, d), "source_document_id", ["page_number", "page_id"], "text")


LAYER_VERDICTS = """
WITH p AS (SELECT source_document_id, page_number, page_id, CASE WHEN confidence < 75 THEN '' WHEN confidence < 82 THEN regexp_replace(text, '[aeiouা]', '(cid:7)', 'g') ELSE text END AS text FROM ocr_pages WHERE source_document_id IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY source_document_id) AS pages, row_number() OVER (PARTITION BY source_document_id ORDER BY page_number ASC NULLS FIRST, page_id) - 1 AS i FROM p),
s AS (SELECT source_document_id, pages, trim(coalesce(text, ''), E' \\t\\n\\r') AS t FROM n WHERE i % greatest(1, pages // 8) = 0 AND i // greatest(1, pages // 8) < 8),
k AS (SELECT source_document_id, pages, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 40 OR length(t) - length(regexp_replace(t, '\\(cid:\\d+\\)', '', 'g')) > 0.2 * length(t) THEN 'garbled' ELSE 'good' END AS kind FROM s),
c AS (SELECT source_document_id, max(pages) AS pages, count(*) AS sampled, count(*) FILTER (WHERE kind = 'good') AS good, count(*) FILTER (WHERE kind = 'garbled') AS garbled, count(*) FILTER (WHERE kind = 'empty') AS empty FROM k GROUP BY 1)
SELECT *, CASE WHEN good = sampled THEN 'text' WHEN good = 0 THEN 'ocr_required' ELSE 'mixed' END AS verdict FROM c
"""


def merged_questions(spark: SparkSession, d: str) -> DataFrame:
    """The stored questions after the last parse has been merged into them."""
    stored, incoming = _two_parses(spark, d)
    after = merge.apply_merge(stored, incoming, _KEYS, merge.merge_plan(stored, incoming, _KEYS, ["marks", "body"]))
    return after.select(*_KEYS, "question_id", "marks")


MERGED_QUESTIONS = f"""
WITH {_PARSES}, same AS (SELECT st.source_document_id, st.question_number FROM st JOIN inc ON st.source_document_id = inc.source_document_id AND st.question_number = inc.question_number
  WHERE st.marks IS NOT DISTINCT FROM inc.marks AND trim(st.body, E' \\t\\n\\r') IS NOT DISTINCT FROM trim(inc.body, E' \\t\\n\\r'))
SELECT source_document_id, question_number, question_id, marks FROM inc WHERE (source_document_id, question_number) NOT IN (SELECT (source_document_id, question_number) FROM same)
UNION ALL SELECT source_document_id, question_number, question_id, marks FROM st WHERE (source_document_id, question_number) IN (SELECT (source_document_id, question_number) FROM same) OR source_document_id NOT IN (SELECT source_document_id FROM inc)
"""


def citation_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks like [12] in the raw texts of chunks, held against sixty numbered contexts: the valid ones in order, and how many were taken out."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).where("text_raw is not null")
    text, cited, dropped = answers.citations(F.col("text_raw"), F.lit(60))
    rows = c.select("chunk_id", F.array_join(F.transform(cited, lambda x: x.cast("string")), ",").alias("cited"), dropped.alias("dropped"), F.length(text).alias("chars"))
    return rows.where("cited <> '' or dropped > 0").select("chunk_id", "cited", "dropped", F.when(F.col("dropped") == 0, F.col("chars")).alias("chars_if_untouched"))


CITATION_MARKS = """
WITH c AS (SELECT DISTINCT chunk_id, text_raw AS t FROM chunks WHERE text_raw IS NOT NULL), m AS (SELECT *, list_transform(regexp_extract_all(t, '\\[([0-9]{1,2})\\]', 1), lambda x: CAST(x AS INTEGER)) AS n FROM c),
o AS (SELECT chunk_id, t, list_filter(n, lambda x: x BETWEEN 1 AND 60) AS good, CAST(len(list_filter(n, lambda x: NOT (x BETWEEN 1 AND 60))) AS INTEGER) AS dropped FROM m)
SELECT chunk_id, array_to_string(list_filter(good, lambda x, i: list_position(good, x) = i), ',') AS cited, dropped, CAST(CASE WHEN dropped = 0 THEN length(t) END AS INTEGER) AS chars_if_untouched FROM o WHERE len(good) > 0 OR dropped > 0
"""


def record_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per source document: its records, and how many lack each field, counted once a record."""
    from inkwell.plans.corpus import _records

    r = _records(spark, d).where("content is not null")
    empty = lambda c: X.blank_to_null(F.col(c)).isNull()
    keywords = F.size(F.filter(F.coalesce("m.keywords", F.array().cast("array<string>")), lambda k: F.trim(k) != "")) == 0
    page = ~F.coalesce(F.col("m.page_no").rlike("^-?[0-9]{1,9}$"), F.lit(False))
    gaps = {"no_chapter": empty("m.chapter_title") & empty("m.chapter_name"), "no_topic": empty("m.topic"), "no_keywords": keywords, "no_reference": empty("m.spec_ref"), "no_page": page, "no_prerequisite": empty("m.prerequisite")}
    unknown = X.script_language(F.col("content"), F.lit(None).cast("string")) == "unknown"
    return r.groupBy("source_document_id").agg(F.count("*").alias("records"), *[F.count_if(c).alias(n) for n, c in gaps.items()], F.count_if(unknown).alias("language_unknown"))


_JS = "json_extract_string(m, '$.{}')"
_EMPTY = "(coalesce(trim({0}), '') = '')"
RECORD_GAPS = f"""
WITH r AS (SELECT *, CASE WHEN json_valid(meta_json) THEN meta_json END AS m FROM legacy_records WHERE content IS NOT NULL)
SELECT source_document_id, count(*) AS records, count(*) FILTER (WHERE {_EMPTY.format(_JS.format('chapter_title'))} AND {_EMPTY.format(_JS.format('chapter_name'))}) AS no_chapter,
  count(*) FILTER (WHERE {_EMPTY.format(_JS.format('topic'))}) AS no_topic, count(*) FILTER (WHERE len(list_filter(coalesce(CAST(json_extract(m, '$.keywords') AS VARCHAR[]), []), lambda k: trim(k) <> '')) = 0) AS no_keywords,
  count(*) FILTER (WHERE {_EMPTY.format(_JS.format('spec_ref'))}) AS no_reference, count(*) FILTER (WHERE NOT coalesce(regexp_matches({_JS.format('page_no')}, '^-?[0-9]{{1,9}}$'), false)) AS no_page,
  count(*) FILTER (WHERE {_EMPTY.format(_JS.format('prerequisite'))}) AS no_prerequisite,
  count(*) FILTER (WHERE NOT regexp_matches(content, '[\\x{{0980}}-\\x{{09FF}}]') AND regexp_matches(content, '^[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]*$')) AS language_unknown FROM r GROUP BY 1
"""


def query_map() -> dict:
    return {
        "catalogue_mismatches": (catalogue_mismatches, CATALOGUE_MISMATCHES),
        "checksum_backfill": (checksum_backfill, CHECKSUM_BACKFILL),
        "classified_paths": (classified_paths, CLASSIFIED_PATHS),
        "built_titles": (built_titles, BUILT_TITLES),
        "paper_groups": (paper_groups, _paper_groups_sql()),
        "offering_evidence": (offering_evidence, OFFERING_EVIDENCE),
        "layer_verdicts": (layer_verdicts, LAYER_VERDICTS),
        "merged_questions": (merged_questions, MERGED_QUESTIONS),
        "citation_marks": (citation_marks, CITATION_MARKS),
        "record_gaps": (record_gaps, RECORD_GAPS),
    }
