"""Citations in answers and numbered contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MARK = "\\[(\\d{1,2})\\]"


def numbered_context(ranked: DataFrame, query: str, rank: str, where: str, text: str, most: int) -> DataFrame:
    """query, n, context: the best `most` texts of each query as one block, each under a heading with its number and place."""
    w = Window.partitionBy(query).orderBy(rank)
    top = ranked.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    part = F.concat(F.lit("<<<CONTEXT "), F.col("__n").cast("string"), F.lit(" | "), F.coalesce(F.col(where), F.lit("")), F.lit(">>>\n"), F.coalesce(F.col(text), F.lit("")))
    block = F.transform(F.array_sort(F.collect_list(F.struct("__n", part.alias("p")))), lambda x: x["p"])
    return top.groupBy(query).agg(F.count("*").alias("n"), F.array_join(block, "\n\n").alias("context"))


def citations(answer: Column, contexts: Column) -> tuple[Column, Column, Column]:
    """(text, cited, dropped): citation marks [n] checked against the number of contexts.

    cited: the valid numbers in order of first use. Invalid marks are taken out of the text and counted in dropped; double
    blanks are closed only where one was taken out. A null answer stays null with no citation.
    """
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(_MARK), F.lit(1)), lambda x: x.cast("int"))
    ok = lambda x: (x >= 1) & (x <= contexts)
    bad = F.array_distinct(F.filter(numbers, lambda x: ~ok(x)))
    pattern = F.concat(F.lit("\\[0?("), F.array_join(F.transform(bad, lambda x: x.cast("string")), "|"), F.lit(")\\]"))
    gone = F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, pattern, F.lit("")), F.lit(" {2,}"), F.lit(" ")), F.lit(" +([.,;])"), F.lit("$1"))
    text = F.when(F.size(bad) > 0, gone).otherwise(answer)
    empty = F.array().cast("array<int>")
    cited = F.coalesce(F.array_distinct(F.filter(numbers, ok)), empty)
    return text, cited, F.coalesce(F.size(F.filter(numbers, lambda x: ~ok(x))), F.lit(0))
