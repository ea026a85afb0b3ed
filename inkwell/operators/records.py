"""Legacy records to chunks: reconcile fields, clean, re-chunk and identify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators.rechunk import rechunk

META = "chapter_title string, chapter_name string, page_no string, topic string, spec_ref string, keywords array<string>, token_count string"
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def rejected(records: DataFrame) -> DataFrame:
    """record_id, reason: records without an id of their own or without content; they make no chunk."""
    reason = F.when(X.blank_to_null(F.col("legacy_chunk_id")).isNull(), "no_chunk_id").when(X.blank_to_null(F.col("content")).isNull(), "no_content")
    return records.select("record_id", reason.alias("reason")).where("reason is not null")


def record_chunks(records: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, chunk_key, record_id, ordinal, chapter, chapter_from, page, keywords, language, text, tokens, status of every piece.

    The chapter is the first of title and name that isn't blank; a page number that isn't a whole number is null; blank
    keywords are dropped. The key is built from the document's checksum and the record's locator, with a part number
    where a record makes several pieces, and the id from the key, so a second run makes the same rows.
    Rejected records and records without a document of known checksum are left out; a copy of a record in one document
    (same locator) makes one chunk, of the smallest record_id.
    """
    bad = rejected(records).select("record_id")
    ok = records.join(bad, "record_id", "left_anti").join(documents.select("source_document_id", "sha256").where("sha256 is not null"), "source_document_id")
    first = ok.groupBy("sha256", "legacy_chunk_id").agg(F.min("record_id").alias("record_id"))
    ok = ok.join(first.select("record_id"), "record_id", "left_semi").withColumn("m", F.from_json("meta_json", META))
    language = X.script_language(F.col("content"), F.lit(None).cast("string"))
    rows = ok.select(
        "record_id",
        "sha256",
        "legacy_chunk_id",
        X.first_filled(F.col("m.chapter_title"), F.col("m.chapter_name")).alias("chapter"),
        F.when(X.blank_to_null(F.col("m.chapter_title")).isNotNull(), "chapter_title").when(X.blank_to_null(F.col("m.chapter_name")).isNotNull(), "chapter_name").alias("chapter_from"),
        F.when(F.col("m.page_no").rlike("^-?[0-9]{1,9}$"), F.col("m.page_no").try_cast("int")).alias("page"),
        F.filter("m.keywords", lambda k: X.strip(k) != "").alias("keywords"),
        language.alias("language"),
        X.normalised(F.col("content")).alias("raw"),
    )
    cleaned = X.clean(rows, "record_id", "raw", "language").withColumnRenamed("key", "record_id").withColumnRenamed("text", "clean")
    both = rows.join(cleaned.select("record_id", "clean"), "record_id")
    pieces = rechunk(both, "record_id", "clean", "language").withColumnRenamed("key", "record_id").drop("carried_words", "char_start", "char_end")
    counts = pieces.groupBy("record_id").agg(F.count("*").alias("pieces"))
    out = pieces.join(counts, "record_id").join(both.withColumn("same", F.col("clean") == F.col("raw")).drop("clean", "raw"), "record_id")
    locator = F.concat(F.lit("legacy/"), "legacy_chunk_id", F.when(F.col("pieces") > 1, F.concat(F.lit("/part/"), (F.col("ordinal") + 1).cast("string"))).otherwise(""))
    key = F.concat_ws(":", F.lit("inkwell"), F.lit("v1"), "sha256", locator)
    status = F.when(F.col("same") & (F.col("pieces") == 1), "verbatim").otherwise("normalized")
    out = out.withColumn("chunk_key", key)
    return out.select(
        X.uuid5(NAMESPACE, F.col("chunk_key")).alias("chunk_id"), "chunk_key", "record_id", "ordinal", "chapter", "chapter_from", "page", "keywords", "language", "text", "tokens", status.alias("status")
    )
