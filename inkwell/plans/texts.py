"""Cleaning, measuring, parsing and re-chunking of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import parsing, records
from inkwell.operators.rechunk import rechunk
from inkwell.sources.tables import table

BN = "[\\x{0980}-\\x{09FF}]"
_COUNT_BN = f"len(regexp_extract_all(text, '{BN}'))"
_WORDS = "len(regexp_extract_all(text, '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'))"


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens, Bengali share and language by script of every document."""
    c = table(spark, d, "documents").where("text is not null")
    est = X.token_estimate(F.col("text"), F.col("lang")).cast("int")
    return c.select("doc_id", est.alias("tokens"), F.round(X.bengali_share(F.col("text")), 6).alias("bengali"), X.script_language(F.col("text"), F.col("lang")).alias("language"))


TOKEN_ESTIMATES = f"""
WITH c AS (SELECT doc_id, text, lang, {_COUNT_BN} AS bn, length(text) AS n, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 WHEN bn > 0.3 * n OR coalesce(lang = 'bn', false) THEN greatest(1, n // 3) ELSE greatest(1, w) END AS INTEGER) AS tokens,
  round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(bn AS DOUBLE) / n END, 6) AS bengali,
  CASE WHEN bn > 0 THEN 'bn' WHEN lang IN ('bn', 'en') THEN lang WHEN regexp_matches(text, '[^\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]') THEN 'en' ELSE 'unknown' END AS language FROM c
"""


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document through all cleaning stages, with the repairs of each."""
    c = table(spark, d, "documents").where("doc_id is not null")
    return X.clean(c, "doc_id", "text", "lang").withColumnRenamed("key", "doc_id")


# The stages in an engine whose patterns have no back references and look to neither side: doubled consonants one by one, bullets
# in two passes since a letter may stand between two of them, breaks marked with their blanks and then judged piece by piece.
_CONSONANTS = "[" + ", ".join(f"chr({c})" for c in [*range(0x995, 0x9BA), 0x9CE, 0x9BC]) + "]"
_SIGN = "[" + "".join(chr(c) for c in (0x9CB, 0x9C7, 0x9CC)) + "]"
_WS = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_STAGES = f"""
pr AS (SELECT list(DISTINCT lower(p)) AS ps FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^\\pL\\pN_])([A-Za-z]{{2,}})-[A-Za-z]{{2,}}(?:$|[^\\pL\\pN_])', 1)) AS p FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(text, '\\b([A-Za-z]{{2,}})-[A-Za-z]{{2,}}\\b', 1)) FROM documents)),
s0 AS (SELECT doc_id, coalesce(lang, '') AS lang, nfc_normalize(text) AS t FROM documents WHERE doc_id IS NOT NULL),
s1 AS (SELECT doc_id, lang, CASE WHEN lang = 'bn' THEN list_reduce(list_prepend(t, {_CONSONANTS}), lambda a, c: regexp_replace(a, c || c || '({_SIGN})', c || '\\1', 'g')) ELSE t END AS t,
  CASE WHEN lang = 'bn' THEN list_sum(list_transform({_CONSONANTS}, lambda c: len(regexp_extract_all(t, c || c || '{_SIGN}')))) ELSE 0 END AS doubled FROM s0),
s2 AS (SELECT *, len(regexp_extract_all(t, '[a-z,;:] e [a-z]')) AS n1, regexp_replace(t, '([a-z,;:]) e ([a-z])', '\\1' || chr(10) || '• \\2', 'g') AS u FROM s1),
s3 AS (SELECT *, n1 + len(regexp_extract_all(u, '[a-z,;:] e [a-z]')) AS n FROM s2),
s4 AS (SELECT doc_id, doubled, CASE WHEN lang = 'en' AND n >= 2 THEN n ELSE 0 END AS bullets, CASE WHEN lang = 'en' AND n >= 2 THEN regexp_replace(u, '([a-z,;:]) e ([a-z])', '\\1' || chr(10) || '• \\2', 'g') ELSE t END AS t FROM s3),
s5 AS (SELECT *, string_split(regexp_replace(t, '(^|[^\\pL\\pN_])([A-Za-z]{{2,}})-({_WS}+)([A-Za-z]{{2,}})', '\\1\\2' || chr(1) || '\\3' || chr(2) || '\\4', 'g'), chr(1)) AS p FROM s4),
s6 AS (SELECT doc_id, doubled, bullets, p, ps, list_transform(p, lambda x, i: i > 1 AND regexp_matches(split_part(x, chr(2), 2), '^[A-Za-z]+($|[^\\pL\\pN_])')) AS ok FROM s5, pr),
s7 AS (SELECT doc_id, doubled, bullets, len(list_filter(ok, lambda x: x)) AS joined, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x WHEN NOT ok[i] THEN '-' || replace(x, chr(2), '')
  WHEN list_contains(ps, lower(regexp_extract(p[i - 1], '([A-Za-z]{{2,}})$', 1))) THEN '-' || split_part(x, chr(2), 2) ELSE split_part(x, chr(2), 2) END), '') AS t FROM s6),
s8 AS (SELECT *, string_split(t, chr(10)) AS l, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t\\r]+$', '')) AS o FROM s7),
s9 AS (SELECT *, array_to_string(o, chr(10)) AS j, regexp_replace(array_to_string(o, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS s FROM s8),
cleaned AS (SELECT doc_id, regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g') AS text, CAST(coalesce(doubled, 0) AS INTEGER) AS doubled, CAST(coalesce(bullets, 0) AS INTEGER) AS bullets, CAST(coalesce(joined, 0) AS INTEGER) AS joined,
  CAST(coalesce(len(list_filter(list_zip(l, o), lambda x: x[1] <> x[2])) + (CASE WHEN s <> j THEN 1 ELSE 0 END), 0) AS INTEGER) AS spaces FROM s9)"""
CLEANED = f"WITH {_STAGES} SELECT * FROM cleaned"
REPAIR_TOTALS = f"WITH {_STAGES} " + " UNION ALL ".join(f"SELECT '{c}' AS stage, count(*) FILTER (WHERE {c} > 0) AS texts, CAST(sum({c}) AS BIGINT) AS repairs FROM cleaned" for c in ("doubled", "bullets", "joined", "spaces"))


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a bad extraction would hand them over: consonants doubled before some signs, bullets and commas read as e, words broken at -tion."""
    t = F.when(F.col("lang") == "bn", F.regexp_replace("text", "([\\u0995-\\u09B9])([\\u09CB\\u09C7\\u09CC])", "$1$1$2")).otherwise(F.col("text"))
    t = F.regexp_replace(F.regexp_replace(t, "([a-z]), ([a-z])", "$1 e $2"), "([a-z]{3})(tion )", "$1-  $2")
    return table(spark, d, "documents").select("doc_id", "lang", t.alias("text"))


_DAMAGED = """src AS (SELECT doc_id, lang, regexp_replace(regexp_replace(CASE WHEN lang = 'bn' THEN regexp_replace(text, '([\\x{0995}-\\x{09B9}])([\\x{09CB}\\x{09C7}\\x{09CC}])', '\\1\\1\\2', 'g') ELSE text END,
  '([a-z]), ([a-z])', '\\1 e \\2', 'g'), '([a-z]{3})(tion )', '\\1-  \\2', 'g') AS text FROM documents)"""


def cleaned_damage(spark: SparkSession, d: str) -> DataFrame:
    """Damaged documents through all cleaning stages, by the checksum of what comes out."""
    c = X.clean(_damaged(spark, d).where("doc_id is not null"), "doc_id", "text", "lang")
    return c.select(F.col("key").alias("doc_id"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), "doubled", "bullets", "joined", "spaces")


CLEANED_DAMAGE = f"WITH {_DAMAGED}, {_STAGES.replace('FROM documents', 'FROM src')} SELECT doc_id, sha256(text) AS sha256, doubled, bullets, joined, spaces FROM cleaned"


def repair_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents repaired and repairs made by each stage."""
    c = cleaned(spark, d)
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in ("doubled", "bullets", "joined", "spaces")]))
    return c.select(stages.alias("s")).groupBy(F.col("s.stage").alias("stage")).agg(F.count_if(F.col("s.n") > 0).alias("texts"), F.sum("s.n").cast("long").alias("repairs"))


def compound_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return X.compound_prefixes(table(spark, d, "documents"), "text")


COMPOUND_PREFIXES = "SELECT DISTINCT lower(split_part(unnest(regexp_extract_all(text, '\\b[A-Za-z]{2,}-[A-Za-z]{2,}\\b')), '-', 1)) AS prefix FROM documents"


def tidy(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages with their white space tidied, and the lines that changed."""
    p = table(spark, d, "ocr_pages").where("text is not null")
    t, n = X.tidy_space(F.col("text"))
    return p.select("page_id", F.sha2(F.encode(t, "utf-8"), 256).alias("sha256"), n.cast("int").alias("changed"))


TIDY = """
WITH l AS (SELECT page_id, string_split(text, chr(10)) AS l FROM ocr_pages WHERE text IS NOT NULL),
o AS (SELECT page_id, l, list_transform(l, lambda x: regexp_replace(regexp_replace(x, '[ \\t]{2,}', ' ', 'g'), '[ \\t\\r]+$', '')) AS o FROM l),
j AS (SELECT page_id, l, o, array_to_string(o, chr(10)) AS j FROM o), s AS (SELECT *, regexp_replace(j, '\\n{3,}', chr(10) || chr(10), 'g') AS s FROM j)
SELECT page_id, sha256(regexp_replace(s, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}]+$', '', 'g')) AS sha256,
  CAST(len(list_filter(list_zip(l, o), lambda x: x[1] <> x[2])) + (CASE WHEN s <> j THEN 1 ELSE 0 END) AS INTEGER) AS changed FROM s
"""


def spec_references(spark: SparkSession, d: str) -> DataFrame:
    """Section references of scanned pages before and after the lost dots are put back, as one sorted set."""
    p = table(spark, d, "ocr_pages").where("text is not null")
    both = F.array_sort(F.array_union(X.references(F.col("text")), X.references(X.repair_references(F.col("text")))))
    return p.select("page_id", F.array_join(both, ",").alias("refs")).where("refs <> ''")


_REF = "regexp_extract_all({}, '\\b[1-8]\\.\\d{{1,2}}\\.\\d{{1,2}}\\b')"
SPEC_REFERENCES = f"""
SELECT page_id, refs FROM (SELECT page_id, array_to_string(list_sort(list_distinct(list_concat({_REF.format('text')},
  {_REF.format("regexp_replace(text, '\\b([1-8])(\\d)(\\d)\\b', '\\1.\\2.\\3', 'g')")}))), ',') AS refs FROM ocr_pages WHERE text IS NOT NULL) WHERE refs <> ''
"""


def exam_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the documents' exam papers, cut at their terminators."""
    q = parsing.terminated_questions(table(spark, d, "documents"), "doc_id", "text")
    return q.select("doc_id", "ordinal", "question_number", "marks", F.length("block").alias("chars"))


EXAM_QUESTIONS = """
WITH t AS (SELECT doc_id, string_split_regex(text, '\\(Total for Question \\d+ = \\d+ marks?\\)') AS b, regexp_extract_all(text, '\\(Total for Question (\\d+) = (\\d+) marks?\\)', 1) AS q,
  regexp_extract_all(text, '\\(Total for Question (\\d+) = (\\d+) marks?\\)', 2) AS m FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, b, q, m, unnest(range(len(q))) AS k FROM t)
SELECT doc_id, CAST(k AS INTEGER) AS ordinal, CAST(q[k + 1] AS INTEGER) AS question_number, CAST(m[k + 1] AS INTEGER) AS marks,
  CAST(length(regexp_replace(b[k + 1], '^[ \\t\\n\\f\\r\\v]+|[ \\t\\n\\f\\r\\v]+$', '', 'g')) AS INTEGER) AS chars FROM u
"""


def numbering_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = parsing.numbering_gaps(table(spark, d, "parsed_questions"), "source_document_id", "question_number")
    return g.select(F.col("paper").alias("source_document_id"), "found", "highest", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


NUMBERING_GAPS = """
WITH n AS (SELECT source_document_id, list_distinct(list(CAST(question_number AS INTEGER))) AS got, max(CAST(question_number AS INTEGER)) AS highest FROM parsed_questions
  WHERE source_document_id IS NOT NULL AND regexp_matches(question_number, '^[0-9]{1,4}$') GROUP BY 1)
SELECT source_document_id, CAST(len(got) AS INTEGER) AS found, highest, array_to_string(list_filter(range(1, highest + 1), lambda x: NOT list_contains(got, x)), ',') AS missing FROM n WHERE highest >= 1
"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    """All documents cut into overlapping windows."""
    return rechunk(table(spark, d, "documents"), "doc_id", "text", "lang").withColumnRenamed("key", "doc_id")


def record_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all legacy records."""
    return records.record_chunks(table(spark, d, "legacy_records"), table(spark, d, "source_documents"))


def whole_record_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the records that make one chunk each, with their keywords as one string and the checksum of their text."""
    c = record_chunks(spark, d).where("not contains(chunk_key, '/part/')")
    return c.select("chunk_id", "chunk_key", "record_id", "chapter", "chapter_from", "page", F.array_join("keywords", "|").alias("keywords"), "language", "tokens", "status", F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"))


_J = "json_extract_string(m, '$.{}')"
_IN_LINE = "[" + _WS[1:-1].replace("\\s", " \\t\\r\\f") + "]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _filled_sql(x: str) -> str:
    return f"nullif({_strip_sql(x)}, '')"


WHOLE_RECORD_CHUNKS = f"""
WITH ok AS (SELECT r.record_id, s.sha256, r.legacy_chunk_id, r.content, CASE WHEN json_valid(r.meta_json) THEN r.meta_json END AS m FROM legacy_records r JOIN source_documents s ON s.source_document_id = r.source_document_id
  WHERE s.sha256 IS NOT NULL AND {_filled_sql('r.legacy_chunk_id')} IS NOT NULL AND {_filled_sql('r.content')} IS NOT NULL),
fi AS (SELECT * FROM ok WHERE record_id IN (SELECT min(record_id) FROM ok GROUP BY sha256, legacy_chunk_id)),
src AS (SELECT record_id AS doc_id, CASE WHEN regexp_matches(content, '[\\x{{0980}}-\\x{{09FF}}]') THEN 'bn' ELSE 'en' END AS lang, {_strip_sql(f"regexp_replace(nfc_normalize(content), '{_IN_LINE}+(\n|$)', '\\1', 'g')")} AS text FROM fi),
{_STAGES.replace('FROM documents', 'FROM src')},
c AS (SELECT fi.*, src.lang, src.text AS raw, cl.text AS t, {_COUNT_BN.replace('text', 'cl.text')} AS bn, {_WORDS.replace('text', 'cl.text')} AS w FROM fi JOIN src ON src.doc_id = fi.record_id JOIN cleaned cl ON cl.doc_id = fi.record_id),
k AS (SELECT *, CASE WHEN lang = 'bn' OR bn > 0.3 * length(t) THEN greatest(1, length(t) // 3) ELSE greatest(1, w) END AS tokens, 'inkwell:v1:' || sha256 || ':legacy/' || legacy_chunk_id AS k FROM c WHERE t <> ''),
h AS (SELECT *, sha1(from_hex('{records.NAMESPACE.replace('-', '')}') || encode(k)) AS h FROM k WHERE tokens <= 600)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id, k AS chunk_key, record_id,
  coalesce({_filled_sql(_J.format('chapter_title'))}, {_filled_sql(_J.format('chapter_name'))}) AS chapter,
  CASE WHEN {_filled_sql(_J.format('chapter_title'))} IS NOT NULL THEN 'chapter_title' WHEN {_filled_sql(_J.format('chapter_name'))} IS NOT NULL THEN 'chapter_name' END AS chapter_from,
  CASE WHEN regexp_matches({_J.format('page_no')}, '^-?[0-9]{{1,9}}$') THEN CAST({_J.format('page_no')} AS INTEGER) END AS page,
  array_to_string(list_filter(CAST(json_extract(m, '$.keywords') AS VARCHAR[]), lambda x: {_strip_sql('x')} <> ''), '|') AS keywords, lang AS language, CAST(tokens AS INTEGER) AS tokens,
  CASE WHEN t = raw THEN 'verbatim' ELSE 'normalized' END AS status, sha256(t) AS sha256 FROM h
"""


def rejected_records(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(table(spark, d, "legacy_records"))


_BLANK = "regexp_matches({}, '^[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]*$')"
REJECTED_RECORDS = f"""
SELECT * FROM (SELECT record_id, CASE WHEN legacy_chunk_id IS NULL OR {_BLANK.format('legacy_chunk_id')} THEN 'no_chunk_id' WHEN content IS NULL OR {_BLANK.format('content')} THEN 'no_content' END AS reason FROM legacy_records) WHERE reason IS NOT NULL
"""


def query_map() -> dict:
    return {
        "token_estimates": (token_estimates, TOKEN_ESTIMATES),
        "cleaned": (cleaned, CLEANED),
        "cleaned_damage": (cleaned_damage, CLEANED_DAMAGE),
        "repair_totals": (repair_totals, REPAIR_TOTALS),
        "compound_prefixes": (compound_prefixes, COMPOUND_PREFIXES),
        "tidy": (tidy, TIDY),
        "spec_references": (spec_references, SPEC_REFERENCES),
        "exam_questions": (exam_questions, EXAM_QUESTIONS),
        "numbering_gaps": (numbering_gaps, NUMBERING_GAPS),
        "windows": (windows, None),
        "record_chunks": (record_chunks, None),
        "whole_record_chunks": (whole_record_chunks, WHOLE_RECORD_CHUNKS),
        "rejected_records": (rejected_records, REJECTED_RECORDS),
    }
