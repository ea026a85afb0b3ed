"""File sources and sinks: JSON lines strict and tolerant, binary catalogues, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from inkwell.session import folder_exists

RECORD = (
    "chunk_id string, class string, subject string, chapter_no string, chapter_title string, chapter_name string, page_no string, topic string, "
    "prerequisite string, spec_ref string, keywords array<string>, token_count string, content string"
)


def strict_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str = RECORD) -> DataFrame:
    """Records of JSON-lines files with their file name. Blank lines are skipped; a line that isn't valid JSON fails the job."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(paths)
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def tolerant_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str = RECORD, pattern: str = "*.jsonl") -> DataFrame:
    """Records and errors of JSON-lines files: file_name, record, raw, error.

    error is `parse` for a line that isn't JSON, `not_object` for JSON of another kind, else null; blank lines are
    skipped, and bytes that aren't UTF-8 become replacement characters.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(paths).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    lines = lines.where(F.trim("raw") != "").withColumn("kind", F.schema_of_variant(F.try_parse_json("raw")))
    error = F.when(F.col("kind").isNull(), "parse").when(~F.col("kind").startswith("OBJECT"), "not_object")
    return lines.select("file_name", "raw", error.alias("error")).withColumn("record", F.when(F.col("error").isNull(), F.from_json("raw", schema)))


def file_catalogue(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, folder, bytes, modified, sha256 of every file under a root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    return df.select(
        "path",
        F.element_at(parts, -1).alias("name"),
        F.element_at(parts, -2).alias("folder"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha256"),
    )


def layer_verdict(pages: DataFrame, key: str, page: str | list[str], text: str, *, least: int = 40, bad_share: float = 0.2, sample: int = 8) -> DataFrame:
    """key, pages, sampled, good, garbled, empty, verdict: whether documents have a usable text layer.

    Of every document's pages, in the order of `page`, each pages div sample-th is looked at, at most `sample` of them. A page
    is empty without text, garbled when it has fewer than `least` characters or more than bad_share of it are `(cid:N)` marks,
    else good. The verdict is text when all pages looked at are good, ocr_required when none is, mixed between; a document
    without pages has no row and is unknown. Rows with a null key are left out.
    """
    rows = pages.where(F.col(key).isNotNull())
    n = rows.groupBy(key).agg(F.count("*").alias("pages"))
    w = Window.partitionBy(key).orderBy(*([page] if isinstance(page, str) else page))
    step = F.greatest(F.lit(1), F.expr(f"pages div {sample}"))
    rows = rows.join(n, key).withColumn("i", F.row_number().over(w) - 1).where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < sample))
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^\\s+|\\s+$", "")
    marks = F.length(t) - F.length(F.regexp_replace(t, "\\(cid:\\d+\\)", ""))
    kind = F.when(t == "", "empty").when((F.length(t) < least) | (marks > bad_share * F.length(t)), "garbled").otherwise("good")
    each = rows.withColumn("kind", kind).groupBy(key).agg(
        F.max("pages").alias("pages"), F.count("*").alias("sampled"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("good", "garbled", "empty")]
    )
    verdict = F.when(F.col("good") == F.col("sampled"), "text").when(F.col("good") == 0, "ocr_required").otherwise("mixed")
    return each.withColumn("verdict", verdict)


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON document that runs over many lines (one row an object, or an array's objects); a broken one fails the job."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def first_text(df: DataFrame, fields: list[str], out: str = "text") -> DataFrame:
    """df with the first of the fields that it has and that isn't null; a field the rows don't have counts as null."""
    there = [F.col(f"`{f}`").cast("string") for f in fields if f in df.columns]
    return df.withColumn(out, F.coalesce(*there, F.lit(None).cast("string")))


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A table of counts as Markdown, in the order of its columns from left to right; for reports of at most `most` rows."""
    rows = df.orderBy(*[F.col(f"`{c}`") for c in df.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---:" if t in ("bigint", "int", "double") else "---" for _, t in df.dtypes], *[[show(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def is_stale(spark: SparkSession, path: str, report: str) -> bool:
    """Whether the text kept at a path isn't the report as it would be written now; no file is stale."""
    if not folder_exists(spark, path):
        return True
    kept = spark.read.text(path, wholetext=True).first()
    return kept is None or kept.value != report


def write_report(df: DataFrame, path: str) -> None:
    """Counts as JSON lines, one file set per report; replaces an earlier report."""
    df.write.mode("overwrite").json(path)
