"""Exam papers and mark schemes: questions, nested parts, reports, answers and the chunks made of them.

The pages of a paper are the parsed questions of a document in page order. The pages of its mark scheme are made from them:
totals in a mark scheme's wording, and the options of one-mark questions as the sentences of a choice table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import papers as P
from inkwell.operators import parsing
from inkwell.plans.corpus import NAMESPACE
from inkwell.session import staged
from inkwell.sources.tables import table

_WS = "[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "parsed_questions").where("source_document_id is not null and text_raw is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("question_id", "text_raw"))), lambda x: x["text_raw"])
    return q.groupBy(F.col("source_document_id").alias("doc"), F.coalesce("page_number", F.lit(0)).alias("page")).agg(F.array_join(texts, "\n").alias("text"))


_OPTION_LINE = "(?m)^([B-D]) (.+)$"
_FIRST_OPTION = "(?m)^A (.+)$"
_CHOICE_TOTAL = "\\(Total for Question \\d+ = 1 mark\\)"


def _scheme_pages(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("text", _CHOICE_TOTAL, "")
    t = F.regexp_replace(t, "\\(Total for Question (\\d+) = (\\d+) marks\\)", "Total for question $1 $2")
    t = F.regexp_replace(F.regexp_replace(t, _FIRST_OPTION, "The correct answer is A ($1)"), _OPTION_LINE, "$1 is incorrect because of $2")
    return _pages(spark, d).select("doc", "page", t.alias("text"))


_PAGES = """pages AS (SELECT source_document_id AS doc, coalesce(page_number, 0) AS page, string_agg(text_raw, chr(10) ORDER BY question_id) AS text
  FROM parsed_questions WHERE source_document_id IS NOT NULL AND text_raw IS NOT NULL GROUP BY 1, 2)"""
_SCHEME_PAGES = f"""{_PAGES}, scheme AS (SELECT doc, page, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_CHOICE_TOTAL}', '', 'g'),
  '\\(Total for Question (\\d+) = (\\d+) marks\\)', 'Total for question \\1 \\2', 'g'), '{_FIRST_OPTION}', 'The correct answer is A (\\1)', 'g'), '{_OPTION_LINE}', '\\1 is incorrect because of \\2', 'g') AS text FROM pages)"""


def _blocks_sql(source: str, terminator: str) -> str:
    return f"""ln AS (SELECT doc, page, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT doc, page, string_split(regexp_replace(text, '{terminator}', chr(10) || chr(1) || '\\1=' || chr(1) || '\\2' || chr(10), 'g'), chr(10)) AS s FROM {source})),
nm AS (SELECT *, nullif(regexp_extract(line, '^\\x01(\\d+)=\\x01(\\d+)$', 1), '') AS number, TRY_CAST(nullif(regexp_extract(line, '^\\x01(\\d+)=\\x01(\\d+)$', 2), '') AS INTEGER) AS marks FROM ln),
bl AS (SELECT *, count(number) OVER (PARTITION BY doc ORDER BY page, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM nm)"""


_LAYOUT = ", ".join(f"'{x}'" for x in P.LAYOUT_LINES)
_QUESTION_LINES = f"""{_PAGES}, {_blocks_sql('pages', P.TERMINATOR)},
en AS (SELECT doc, block, number AS q, marks AS m, page AS page_end, lag(page) OVER (PARTITION BY doc ORDER BY block) AS page_start FROM bl WHERE number IS NOT NULL),
b0 AS (SELECT doc, block, page, n, {_strip('line')} AS bare, line FROM bl WHERE number IS NULL),
b1 AS (SELECT doc, block, page, n, bare, CASE WHEN bare = '' THEN '' ELSE regexp_replace(regexp_replace(line, '\\.{{6,}}', ' ', 'g'), '\\s+$', '') END AS line FROM b0
  WHERE NOT (bare <> '' AND (lower(bare) IN ({_LAYOUT}) OR regexp_matches(line, '{P.PRINT_CODE}') OR regexp_matches(bare, '^\\d{{1,3}}$')))),
b2 AS (SELECT *, min(page) OVER (PARTITION BY doc) AS first_page FROM b1 WHERE bare = '' OR line <> ''),
b3 AS (SELECT b2.*, en.q, en.m, en.page_end, coalesce(en.page_start, b2.first_page) AS page_start, min(CASE WHEN regexp_extract(line, '^\\s*(\\d+)\\s+\\S', 1) = en.q THEN {{'page': page, 'n': n}} END) OVER (PARTITION BY b2.doc, b2.block) AS open
  FROM b2 JOIN en ON en.doc = b2.doc AND en.block = b2.block),
ql AS (SELECT * FROM b3 WHERE open IS NULL OR {{'page': page, 'n': n}} >= open),
qt AS (SELECT doc, block, q, m, page_start, page_end, {_strip("regexp_replace(string_agg(line, chr(10) ORDER BY page, n), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM ql GROUP BY 1, 2, 3, 4, 5, 6),
qs AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY block) - 1 AS INTEGER) AS ordinal FROM qt WHERE text <> '')"""


def _part_sql(lines: str, keys: str, order: str) -> str:
    struct = "{" + ", ".join(f"'{o.strip()}': {o.strip()}" for o in order.split(",")) + "}"
    return f"""p0 AS (SELECT {keys}, {order}, nullif(regexp_extract(line, '{P.PART}', 1), '') AS letter, nullif(regexp_extract(line, '{P.NUMERAL}', 1), '') AS numeral, TRY_CAST(nullif(regexp_extract(line, '{P.PART_MARKS}', 1), '') AS INTEGER) AS m FROM {lines}),
p1 AS (SELECT *, numeral IS NOT NULL AND (length(numeral) > 1 OR count(letter) OVER w > 0) AS nested FROM p0 WINDOW w AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p2 AS (SELECT *, CASE WHEN letter IS NOT NULL AND NOT nested THEN '(' || letter || ')' END AS one FROM p1),
p3 AS (SELECT *, CASE WHEN nested THEN coalesce(last_value(one IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '(' || numeral || ')' ELSE one END AS label,
  CASE WHEN nested THEN 2 WHEN one IS NOT NULL THEN 1 END AS level FROM p2),
p4 AS (SELECT *, count(label) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM p3),
parts AS (SELECT {keys}, CAST(place - 1 AS INTEGER) AS place, max(label) AS label, max(level) AS level, arg_min(m, {struct}) FILTER (WHERE m IS NOT NULL) AS marks FROM p4 WHERE place > 0 GROUP BY ALL)"""


def paper_questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions of every paper without the layout, by the checksum of their text."""
    q = P.paper_questions(_pages(spark, d), "doc", "page", "text")
    return q.select("doc", "ordinal", "question_number", "marks", "page_start", "page_end", F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"))


PAPER_QUESTIONS = f"WITH {_QUESTION_LINES} SELECT doc, ordinal, q AS question_number, m AS marks, page_start, page_end, sha256(text) AS sha256 FROM qs"


def _question_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = staged(P.paper_questions(_pages(spark, d), "doc", "page", "text"), "questions")
    lines = q.select("doc", "ordinal", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return q, P.nested_parts(lines, ["doc", "ordinal"], ["n"])


_PARTS = f"""{_QUESTION_LINES}, tl AS (SELECT doc, ordinal, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT doc, ordinal, string_split(text, chr(10)) AS s FROM qs)), {_part_sql('tl', 'doc, ordinal', 'n')}"""


def paper_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every question of a paper, with their level and marks."""
    return _question_parts(spark, d)[1]


PAPER_PARTS = f"WITH {_PARTS} SELECT * FROM parts"


def paper_report(spark: SparkSession, d: str) -> DataFrame:
    """Per paper: questions, marks, numbers missing, and how many parts each question has."""
    r = P.paper_report(*_question_parts(spark, d))
    counts = F.array_join(F.array_sort(F.transform(F.map_entries("part_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return r.select("doc", "questions", "marks", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), counts.alias("part_counts"))


PAPER_REPORT = f"""WITH {_PARTS}, c AS (SELECT doc, ordinal, count(*) AS parts FROM parts GROUP BY 1, 2),
k AS (SELECT qs.doc, qs.q, qs.m, coalesce(c.parts, 0) AS parts, CAST(qs.q AS INTEGER) AS k FROM qs LEFT JOIN c ON c.doc = qs.doc AND c.ordinal = qs.ordinal)
SELECT doc, count(*) AS questions, CAST(sum(m) AS BIGINT) AS marks, array_to_string(list_filter(range(1, max(k) + 1), lambda x: NOT list_contains(list(k), x)), ',') AS missing,
  array_to_string(list_sort(list_distinct(list(q || ':' || parts))), ',') AS part_counts FROM k GROUP BY 1"""


def sub_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every parsed question as its text has them: label, level, and the marks found under it."""
    q = table(spark, d, "parsed_questions").where("text_raw is not null")
    return P.nested_parts(q.select("question_id", F.posexplode(F.split("text_raw", "\n", -1)).alias("n", "line")), ["question_id"], ["n"])


SUB_PARTS = f"""WITH tl AS (SELECT question_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT question_id, string_split(text_raw, chr(10)) AS s FROM parsed_questions WHERE text_raw IS NOT NULL)),
{_part_sql('tl', 'question_id', 'n')} SELECT * FROM parts"""


def nested_sub_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same for papers that set two parts under the first: lines of options stand as numerals under a part (a)."""
    q = table(spark, d, "parsed_questions").where("text_raw is not null")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text_raw", "(?m)^\\(b\\) ", "(i) "), "(?m)^\\(c\\) ", "(ii) "), "(?m)^\\(d\\) ", "(b) ")
    lines = q.select("question_id", F.posexplode(F.split(t, "\n", -1)).alias("n", "line"))
    return P.nested_parts(lines, ["question_id"], ["n"])


NESTED_SUB_PARTS = f"""WITH tl AS (SELECT question_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT question_id,
  string_split(regexp_replace(regexp_replace(regexp_replace(text_raw, '(?m)^\\(b\\) ', '(i) ', 'g'), '(?m)^\\(c\\) ', '(ii) ', 'g'), '(?m)^\\(d\\) ', '(b) ', 'g'), chr(10)) AS s FROM parsed_questions WHERE text_raw IS NOT NULL)),
{_part_sql('tl', 'question_id', 'n')} SELECT * FROM parts"""


def scheme_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answers of every mark scheme in order, by the checksum of their text."""
    a = P.scheme_answers(_scheme_pages(spark, d), "doc", "page", "text")
    return a.select("doc", "ordinal", "question_number", "strategy", "marks", "answer", F.array_join("distractors", "").alias("distractors"), "page", F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"))


_NOISE = P.SCHEME_NOISE
_ANSWERS = f"""{_SCHEME_PAGES}, {_blocks_sql('scheme', P.SCHEME_TOTAL)},
sk AS (SELECT doc, block, {_strip("regexp_replace(string_agg(regexp_replace(line, '\\s+$', ''), chr(10) ORDER BY page, n), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM bl WHERE number IS NULL AND NOT regexp_matches(line, '{_NOISE}') GROUP BY 1, 2),
st AS (SELECT b.doc, b.number AS question_number, 'terminator' AS strategy, b.marks, CAST(NULL AS VARCHAR) AS answer, CAST([] AS VARCHAR[]) AS distractors, b.page, sk.text FROM bl b JOIN sk ON sk.doc = b.doc AND sk.block = b.block WHERE b.number IS NOT NULL AND sk.text <> ''),
r0 AS (SELECT *, upper(coalesce(nullif(regexp_extract(line, '{P.CHOICE}', 1), ''), nullif(regexp_extract(line, '{P.CHOICE}', 2), ''))) AS "right", nullif(regexp_extract(line, '{P.NUMBERED}', 1), '') AS row FROM bl),
r1 AS (SELECT *, "right" IS NOT NULL OR number IS NOT NULL OR (row IS NOT NULL AND NOT regexp_matches(line, '{P.DISTRACTOR}')) AS starts FROM r0),
r2 AS (SELECT *, count(CASE WHEN starts THEN 1 END) OVER w AS run, last_value(row IGNORE NULLS) OVER w AS q FROM r1 WINDOW w AS (PARTITION BY doc, page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r3 AS (SELECT doc, page, run, arg_min(q, n) FILTER (WHERE starts) AS question_number, arg_min("right", n) FILTER (WHERE starts) AS answer,
  {_strip(f"regexp_replace(string_agg({_strip('line')}, chr(10) ORDER BY n), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM r2 WHERE number IS NULL AND NOT regexp_matches(line, '{_NOISE}') GROUP BY 1, 2, 3),
r4 AS (SELECT *, row_number() OVER (PARTITION BY doc, question_number ORDER BY page, run) AS r FROM r3 WHERE answer IS NOT NULL AND question_number IS NOT NULL AND text <> ''),
ch AS (SELECT doc, question_number, 'mcq_table' AS strategy, 1 AS marks, answer, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{P.DISTRACTOR}', 1), lambda x: upper(x)))) AS distractors, page, text FROM r4 WHERE r = 1),
an AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY CAST(question_number AS INTEGER), strategy, page, text) - 1 AS INTEGER) AS ordinal FROM (SELECT * FROM st UNION ALL SELECT * FROM ch WHERE (doc, question_number) NOT IN (SELECT (doc, question_number) FROM st)))"""
SCHEME_ANSWERS = f"WITH {_ANSWERS} SELECT doc, ordinal, question_number, strategy, marks, answer, array_to_string(distractors, '') AS distractors, page, sha256(text) AS sha256 FROM an"


def scheme_report(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the way they were found."""
    return P.scheme_report(P.scheme_answers(_scheme_pages(spark, d), "doc", "page", "text"))


SCHEME_REPORT = f"WITH {_ANSWERS} SELECT strategy, count(*) AS answers, CAST(sum(marks) AS BIGINT) AS marks, count(answer) AS with_answer, CAST(sum(len(distractors)) AS BIGINT) AS distractors FROM an GROUP BY 1"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_documents").select("source_document_id", "offering_id", "sha256")


def question_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The papers' questions as chunks; papers that were scanned give uncertain ones."""
    route = table(spark, d, "source_documents").select(F.col("source_document_id").alias("doc"), F.when(F.col("ingestion_route") == "ocr", "ocr_tesseract").otherwise("pdf_text_layer").alias("method"))
    q = P.paper_questions(_pages(spark, d), "doc", "page", "text").join(route, "doc", "left")
    c = P.question_chunks(q, _documents(spark, d), F.coalesce("method", F.lit("pdf_text_layer")), namespace=NAMESPACE)
    return c.select("chunk_id", "chunk_key", "offering_id", "ordinal", "question_number", "marks", "page_number", "page_number_end", "extraction_method", "provenance_status", F.length("text").alias("chars"))


_UUID = f"sha1(from_hex('{NAMESPACE.replace('-', '')}') || encode(k))"
_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
QUESTION_CHUNKS = f"""WITH {_QUESTION_LINES}, c AS (SELECT qs.*, s.offering_id, 'inkwell:v1:' || s.sha256 || ':q/' || qs.q AS k, CASE WHEN s.ingestion_route = 'ocr' THEN 'ocr_tesseract' ELSE 'pdf_text_layer' END AS method
  FROM qs JOIN source_documents s ON s.source_document_id = qs.doc WHERE s.sha256 IS NOT NULL), h AS (SELECT *, {_UUID} AS h FROM c)
SELECT {_ID} AS chunk_id, k AS chunk_key, offering_id, ordinal, q AS question_number, m AS marks, page_start AS page_number, page_end AS page_number_end, method AS extraction_method,
  CASE WHEN method = 'ocr_tesseract' THEN 'ocr_uncertain' ELSE 'cleaned' END AS provenance_status, CAST(length(text) AS INTEGER) AS chars FROM h"""


def answer_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The mark schemes' answers as chunks with the note on how each was found."""
    a = P.scheme_answers(_scheme_pages(spark, d), "doc", "page", "text")
    c = P.answer_chunks(a, _documents(spark, d), namespace=NAMESPACE)
    return c.groupBy("chunk_id", "chunk_key").agg(F.min("notes").alias("notes"))


ANSWER_CHUNKS = f"""WITH {_ANSWERS}, c AS (SELECT 'inkwell:v1:' || s.sha256 || ':ms/' || an.question_number AS k, concat_ws(' ', 'Mark scheme, parsed by the ' || strategy || ' strategy.', 'Correct option: ' || answer || '.',
  CASE WHEN len(distractors) > 0 THEN 'Explains why ' || array_to_string(distractors, ', ') || CASE WHEN len(distractors) = 1 THEN ' is' ELSE ' are' END || ' incorrect.' END) AS notes
  FROM an JOIN source_documents s ON s.source_document_id = an.doc WHERE s.sha256 IS NOT NULL), g AS (SELECT k, min(notes) AS notes FROM c GROUP BY 1), h AS (SELECT *, {_UUID} AS h FROM g)
SELECT {_ID} AS chunk_id, k AS chunk_key, notes FROM h"""


def lines_outside(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each parsed question left when what stands between its first part and its total is dropped."""
    q = table(spark, d, "parsed_questions").where("text_raw is not null")
    lines = q.select("question_id", F.posexplode(F.split("text_raw", "\n", -1)).alias("n", "line"))
    left = parsing.drop_between(lines, "question_id", "n", "line", "^\\(a\\)", "^\\(Total for")
    return left.groupBy("question_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


LINES_OUTSIDE = """
WITH l AS (SELECT question_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT question_id, string_split(text_raw, chr(10)) AS s FROM parsed_questions WHERE text_raw IS NOT NULL)),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^\\(a\\)') THEN 'start' WHEN regexp_matches(line, '^\\(Total for') THEN 'end' END AS m FROM l),
s AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY question_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'end') AS state FROM m)
SELECT question_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s WHERE m IS NULL AND state = 'end' GROUP BY 1
"""


def query_map() -> dict:
    return {
        "paper_questions": (paper_questions, PAPER_QUESTIONS),
        "paper_parts": (paper_parts, PAPER_PARTS),
        "paper_report": (paper_report, PAPER_REPORT),
        "sub_parts": (sub_parts, SUB_PARTS),
        "nested_sub_parts": (nested_sub_parts, NESTED_SUB_PARTS),
        "scheme_answers": (scheme_answers, SCHEME_ANSWERS),
        "scheme_report": (scheme_report, SCHEME_REPORT),
        "question_chunks": (question_chunks, QUESTION_CHUNKS),
        "answer_chunks": (answer_chunks, ANSWER_CHUNKS),
        "lines_outside": (lines_outside, LINES_OUTSIDE),
    }
