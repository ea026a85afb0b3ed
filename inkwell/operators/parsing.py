"""Exam papers: questions, sub-parts and marks from the text of a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.joins import asof_join

TERMINATOR = "\\(Total for Question (\\d+) = (\\d+) marks?\\)"


def terminated_questions(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, question_number, marks, block: one row per `(Total for Question N = M marks)` of a text.

    The block is what stands between a terminator and the one before it. Texts without a terminator give no row.
    """
    c = F.col(f"`{text}`")
    parts = F.split(c, TERMINATOR, -1)
    numbers = F.regexp_extract_all(c, F.lit(TERMINATOR), F.lit(1))
    marks = F.regexp_extract_all(c, F.lit(TERMINATOR), F.lit(2))
    zipped = F.arrays_zip(F.slice(parts, 1, F.greatest(F.size(numbers), F.lit(0))).alias("block"), numbers.alias("number"), marks.alias("marks"))
    rows = df.where(c.isNotNull()).select(F.col(f"`{key}`").alias(key), F.posexplode(zipped).alias("ordinal", "q"))
    trim = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    return rows.select(key, "ordinal", F.col("q.number").cast("int").alias("question_number"), F.col("q.marks").cast("int").alias("marks"), trim(F.col("q.block")).alias("block"))


def numbering_gaps(df: DataFrame, paper: str, number: str) -> DataFrame:
    """paper, found, highest, missing: the numbers between 1 and the highest that a paper doesn't have, sorted.

    Numbers that aren't whole numbers of up to four digits are ignored; a paper without any is left out.
    """
    n = F.col(f"`{number}`").try_cast("int")
    rows = df.where(F.col(f"`{paper}`").isNotNull() & F.col(f"`{number}`").rlike("^[0-9]{1,4}$")).select(F.col(f"`{paper}`").alias("paper"), n.alias("n"))
    each = rows.groupBy("paper").agg(F.collect_set("n").alias("got"), F.max("n").alias("highest"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("highest")), F.col("got")))
    return each.where("highest >= 1").select("paper", F.size("got").alias("found"), "highest", missing.alias("missing"))


def drop_between(df: DataFrame, key: str, line_no: str, line: str, start: str, end: str) -> DataFrame:
    """Rows of df outside the blocks that begin with a line matching `start` and last until one matching `end`.

    Both marker lines go too. A block without an end lasts to the end of its text. start and end are Java patterns.
    """
    mark = F.when(F.col(line).rlike(start), "start").when(F.col(line).rlike(end), "end")
    w = Window.partitionBy(key).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__m", mark).withColumn("__state", F.last("__m", ignorenulls=True).over(w))
    return rows.where("__m is null and coalesce(__state, 'end') = 'end'").drop("__m", "__state")


def page_of_offset(pages: DataFrame, offsets: DataFrame, doc: str, page: str, text: str, offset: str) -> DataFrame:
    """offsets with `page`: the page of a document that holds a character offset of its joined text.

    Pages are joined by one newline in page order, so a page starts at the sum of the lengths before it plus one each.
    """
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    sizes = pages.select(doc, page, (F.length(text) + 1).alias("__size"))  # the texts don't take part in the shuffle
    starts = sizes.select(doc, page, F.coalesce(F.sum("__size").over(w), F.lit(0)).alias(offset))
    return asof_join(offsets, starts, [doc], offset, [page])
