"""Exam papers and mark schemes from the text of their pages: questions, nested parts and answers, by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as X

# How papers and mark schemes end a question, and what the layout adds to them.
TERMINATOR = "(?i)\\(\\s*Total\\s+for\\s+Question\\s+(\\d+)\\s*=\\s*(\\d+)\\s*marks?\\s*\\)"
SCHEME_TOTAL = "(?i)Total\\s+for\\s+question\\s+(\\d{1,2})\\s+(\\d{1,2})\\b"
LAYOUT_LINES = (
    "do not write in this area",
    "d o not write in this area",
    "aera siht ni etirw ton od",
    "turn over",
    "do", "not", "write", "in", "this", "area",
    "d", "o",
)
PRINT_CODE = "^\\s*\\*?[A-Z]\\d{5,}[A-Z]?\\d*\\*?\\s*$"
SCHEME_NOISE = (
    "(?i)^\\s*(?:Pearson Education Limited.*|.*Registered Office.*|Publications Code.*|All the material.*|Question\\s+Answer\\s+Mark|Number|Mark|\\d+|)\\s*$"
)
PART = "^\\s*\\(([a-z])\\)"
NUMERAL = "^\\s*\\((i{1,3}|iv|v|vi{1,3}|ix|x{1,3})\\)"
PART_MARKS = "^\\s*\\((\\d{1,2})\\)\\s*$"
CHOICE = "(?i)(?:The\\s+correct\\s+answer\\s+is\\s+([A-D])|([A-D])\\s+is\\s+the\\s+correct\\s+answer)\\b"
DISTRACTOR = "(?i)\\b([A-D])\\s+is\\s+(?:incorrect|not\\s+correct)\\b"
NUMBERED = "^\\s*(\\d{1,2})\\s"

_MARK = "\u0001"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lines_of(pages: DataFrame, doc: str, page: str, text: str, terminator: str) -> DataFrame:
    """doc, page, n, line, number, marks: the lines of pages, numbered within the page; every terminator is a line of its own.

    Null documents and texts are left out. number and marks are those of a terminator, null on other lines.
    """
    own = F.regexp_replace(F.col(text), terminator, f"\n{_MARK}$1={_MARK}$2\n")
    rows = pages.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(F.split(own, "\n", -1)).alias("n", "line"))
    pattern = f"^{_MARK}(\\d+)={_MARK}(\\d+)$"
    number, marks = (_or_null(F.regexp_extract("line", pattern, k)) for k in (1, 2))
    return rows.select("doc", "page", "n", "line", number.alias("number"), marks.cast("int").alias("marks"))


def _blocks(lines: DataFrame) -> DataFrame:
    """lines with block: how many terminators stand before a line, so a terminator closes the block it is numbered with."""
    before = Window.partitionBy("doc").orderBy("page", "n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("block", F.coalesce(F.count("number").over(before), F.lit(0)))


def _ordered(column: str) -> Column:
    """The values of a column of a group in the order of page and line."""
    return F.transform(F.array_sort(F.collect_list(F.struct("page", "n", column))), lambda x: x[column])


def _text(lines: Column) -> Column:
    return X.strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def question_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, block, number, marks, page_start, page_end, page, n, line: the lines of each question of a paper without the layout.

    A question is what stands between two terminators; lines before the one that opens with its number belong to the
    question before. Margin notices, print codes, page numbers of up to three digits and rows of dots go, blank lines stay.
    """
    rows = _blocks(lines_of(pages, doc, page, text, TERMINATOR))
    ends = rows.where("number is not null").select("doc", "block", F.col("number").alias("q"), F.col("marks").alias("m"), F.col("page").alias("page_end"))
    before = Window.partitionBy("doc").orderBy("block")
    ends = ends.withColumn("page_start", F.lag("page_end").over(before))
    bare = X.strip(F.col("line"))
    layout = (bare != "") & (F.lower(bare).isin(*LAYOUT_LINES) | F.col("line").rlike(PRINT_CODE) | bare.rlike("^\\d{1,3}$"))
    body = rows.where(F.col("number").isNull() & ~layout)
    body = body.withColumn("was", bare).withColumn("line", F.when(F.col("was") == "", "").otherwise(F.regexp_replace(F.regexp_replace("line", "\\.{6,}", " "), "\\s+$", "")))
    body = body.where("was = '' or line <> ''").drop("was", "number", "marks")
    first = Window.partitionBy("doc")
    body = body.withColumn("first_page", F.min("page").over(first)).join(ends, ["doc", "block"])
    opens = F.when(F.regexp_extract("line", "^\\s*(\\d+)\\s+\\S", 1) == F.col("q"), F.struct("page", "n"))
    body = body.withColumn("open", F.min(opens).over(Window.partitionBy("doc", "block"))).where("open is null or struct(page, n) >= open")
    return body.select("doc", "block", F.col("q").alias("number"), F.col("m").alias("marks"), F.coalesce("page_start", "first_page").alias("page_start"), "page_end", "page", "n", "line")


def paper_questions(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, ordinal, question_number, marks, text, page_start, page_end of every question that has text left."""
    rows = question_lines(pages, doc, page, text).groupBy("doc", "block", "number", "marks", "page_start", "page_end").agg(_text(_ordered("line")).alias("text"))
    rows = rows.where("text <> ''").withColumn("ordinal", F.row_number().over(Window.partitionBy("doc").orderBy("block")) - 1)
    return rows.select("doc", "ordinal", F.col("number").alias("question_number"), "marks", "text", "page_start", "page_end")


def nested_parts(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, place, label, level, marks: the parts of each question, from its lines.

    `(a)` opens a part of level 1. A numeral is nested under it; `(i)`, `(v)` and `(x)`, which are letters too, only where a
    part is open already, which is where any label of one letter stands above. A part's marks are the first `(n)` alone on a line below it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    above, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(*keys, *order, _or_null(F.regexp_extract("line", PART, 1)).alias("letter"), _or_null(F.regexp_extract("line", NUMERAL, 1)).alias("numeral"), _or_null(F.regexp_extract("line", PART_MARKS, 1)).cast("int").alias("m"))
    rows = rows.withColumn("nested", F.col("numeral").isNotNull() & ((F.length("numeral") > 1) | (F.coalesce(F.count("letter").over(above), F.lit(0)) > 0)))
    rows = rows.withColumn("one", F.when(F.col("letter").isNotNull() & ~F.col("nested"), F.concat(F.lit("("), "letter", F.lit(")"))))
    parent = F.coalesce(F.last("one", ignorenulls=True).over(above), F.lit(""))
    rows = rows.withColumn("label", F.when(F.col("nested"), F.concat(parent, F.lit("("), "numeral", F.lit(")"))).otherwise(F.col("one")))
    rows = rows.withColumn("level", F.when(F.col("nested"), 2).when(F.col("one").isNotNull(), 1)).withColumn("place", F.count("label").over(upto)).where("place > 0")
    at = F.struct(*order)
    each = rows.groupBy(*keys, "place").agg(F.max("label").alias("label"), F.max("level").alias("level"), F.min_by("m", F.when(F.col("m").isNotNull(), at)).alias("marks"))
    return each.select(*keys, (F.col("place") - 1).cast("int").alias("place"), "label", "level", "marks")


def paper_report(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """doc, questions, marks, missing (numbers between 1 and the highest that the paper hasn't), part_counts (question number to parts)."""
    counts = parts.groupBy("doc", "ordinal").agg(F.count("*").alias("parts"))
    rows = questions.join(counts, ["doc", "ordinal"], "left").withColumn("k", F.col("question_number").cast("int"))
    each = rows.groupBy("doc").agg(
        F.count("*").alias("questions"), F.sum("marks").alias("marks"), F.collect_set("k").alias("got"), F.max("k").alias("highest"),
        F.map_from_entries(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "question_number", F.coalesce("parts", F.lit(0)).alias("p")))), lambda x: F.struct(x["question_number"], x["p"])))).alias("part_counts"),
    )
    missing = F.when(F.col("highest") >= 1, F.array_sort(F.array_except(F.sequence(F.lit(1), F.greatest("highest", F.lit(1))), "got"))).otherwise(F.array().cast("array<int>"))
    return each.select("doc", "questions", "marks", missing.alias("missing"), "part_counts")


def scheme_structured(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, question_number, strategy, marks, answer, distractors, page, text: blocks of a mark scheme that end in a question's total."""
    rows = _blocks(lines_of(pages, doc, page, text, SCHEME_TOTAL))
    ends = rows.where("number is not null").select("doc", "block", F.col("number").alias("question_number"), F.col("marks").alias("m"), F.col("page").alias("at"))
    kept = rows.where("number is null").where(~F.col("line").rlike(SCHEME_NOISE)).withColumn("line", F.regexp_replace("line", "\\s+$", ""))
    texts = kept.groupBy("doc", "block").agg(_text(_ordered("line")).alias("text")).where("text <> ''")
    none = F.lit(None).cast("string").alias("answer"), F.array().cast("array<string>").alias("distractors")
    return ends.join(texts, ["doc", "block"]).select("doc", "question_number", F.lit("terminator").alias("strategy"), F.col("m").alias("marks"), *none, F.col("at").alias("page"), "text")


def scheme_choices(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """The same columns for multiple-choice rows: the sentence that names the answer and the lines below it, up to the next row.

    The number is the last one that opened a row of the page. Of several rows of a number in a document the first counts.
    """
    rows = lines_of(pages, doc, page, text, SCHEME_TOTAL)
    w = Window.partitionBy("doc", "page").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    right = F.upper(F.coalesce(_or_null(F.regexp_extract(line, CHOICE, 1)), _or_null(F.regexp_extract(line, CHOICE, 2))))
    rows = rows.withColumn("right", right).withColumn("row", _or_null(F.regexp_extract(line, NUMBERED, 1)))
    starts = F.col("right").isNotNull() | F.col("number").isNotNull() | (F.col("row").isNotNull() & ~line.rlike(DISTRACTOR))
    rows = rows.withColumn("run", F.count(F.when(starts, 1)).over(w)).withColumn("q", F.last("row", ignorenulls=True).over(w)).withColumn("starts", starts)
    rows = rows.where(F.col("number").isNull() & ~line.rlike(SCHEME_NOISE)).withColumn("line", X.strip(line))
    each = rows.groupBy("doc", "page", "run").agg(
        F.min_by("q", F.when(F.col("starts"), F.col("n"))).alias("question_number"), F.min_by("right", F.when(F.col("starts"), F.col("n"))).alias("answer"), _text(_ordered("line")).alias("text")
    )
    each = each.where("answer is not null and question_number is not null and text <> ''")
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("doc", "question_number").orderBy("page", "run"))).where("r = 1")
    wrong = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(DISTRACTOR), F.lit(1)), F.upper)))
    return each.select("doc", "question_number", F.lit("mcq_table").alias("strategy"), F.lit(1).alias("marks"), "answer", wrong.alias("distractors"), "page", "text")


def scheme_answers(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """The answers of mark schemes with their ordinal: structured ones, and multiple-choice ones for the numbers those lack, by number and strategy."""
    first = scheme_structured(pages, doc, page, text)
    more = scheme_choices(pages, doc, page, text).join(first.select("doc", "question_number").distinct(), ["doc", "question_number"], "left_anti")
    both = first.unionByName(more)
    order = Window.partitionBy("doc").orderBy(F.col("question_number").cast("int"), "strategy", "page", "text")
    return both.withColumn("ordinal", F.row_number().over(order) - 1)


def scheme_report(answers: DataFrame) -> DataFrame:
    """strategy, answers, marks, with_answer, distractors over all mark schemes."""
    return answers.groupBy("strategy").agg(
        F.count("*").alias("answers"), F.sum("marks").alias("marks"), F.count("answer").alias("with_answer"), F.sum(F.size("distractors")).alias("distractors")
    )


def _chunk(rows: DataFrame, documents: DataFrame, namespace: str, prefix: str, locator: str) -> DataFrame:
    """rows (doc, question_number, ...) with chunk_key and chunk_id of their document's checksum; documents has source_document_id, offering_id, sha256."""
    known = documents.where("sha256 is not null").select(F.col("source_document_id").alias("doc"), "offering_id", "sha256")
    key = F.concat_ws(":", F.lit(prefix), F.lit("v1"), "sha256", F.concat(F.lit(locator), "question_number"))
    return rows.join(known, "doc").withColumn("chunk_key", key).withColumn("chunk_id", X.uuid5(namespace, F.col("chunk_key"))).drop("sha256")


def question_chunks(questions: DataFrame, documents: DataFrame, method: Column, *, namespace: str, prefix: str = "inkwell") -> DataFrame:
    """Questions as chunks: one a question, cleaned or, from a scan, uncertain; documents without a checksum make none."""
    rows = _chunk(questions, documents, namespace, prefix, "q/")
    status = F.when(method == "ocr_tesseract", "ocr_uncertain").otherwise("cleaned")
    return rows.select("chunk_id", "chunk_key", F.col("doc").alias("source_document_id"), "offering_id", F.lit("exam_question").alias("chunk_type"), "ordinal", "question_number", "marks", F.col("page_start").alias("page_number"), F.col("page_end").alias("page_number_end"), method.alias("extraction_method"), status.alias("provenance_status"), "text")


def answer_chunks(answers: DataFrame, documents: DataFrame, *, namespace: str, prefix: str = "inkwell") -> DataFrame:
    """Answers as chunks: the text through the English cleaning stages, the text as parsed beside it, and a note on how it was found."""
    rows = _chunk(answers, documents, namespace, prefix, "ms/")
    wrong = F.col("distractors")
    notes = F.concat_ws(
        " ",
        F.concat(F.lit("Mark scheme, parsed by the "), "strategy", F.lit(" strategy.")),
        F.concat(F.lit("Correct option: "), "answer", F.lit(".")),
        F.when(F.size(wrong) > 0, F.concat(F.lit("Explains why "), F.array_join(wrong, ", "), F.when(F.size(wrong) == 1, " is").otherwise(" are"), F.lit(" incorrect."))),
    )
    rows = rows.withColumn("notes", notes).withColumn("lang", F.lit("en"))
    cleaned = X.clean(rows.dropDuplicates(["chunk_key"]), "chunk_key", "text", "lang").select(F.col("key").alias("chunk_key"), F.col("text").alias("clean"))
    out = rows.join(cleaned, "chunk_key")
    return out.select("chunk_id", "chunk_key", F.col("doc").alias("source_document_id"), "offering_id", F.lit("mark_scheme_answer").alias("chunk_type"), "ordinal", "question_number", "marks", F.col("page").alias("page_number"), F.col("clean").alias("text"), F.col("text").alias("text_raw"), "notes")
