import json

from pyspark.sql import functions as F

from inkwell.operators import answers, merge, records


def test_citations(spark):
    rows = [(1, "Ohm [2] holds [1], and [2].", 2), (2, "None [3] here [12].", 2), (3, None, 2), (4, "Two  blanks stay.", 1), (5, "bad [0] good [1] [9]", 1)]
    df = spark.createDataFrame(rows, "id int, a string, n int")
    text, cited, dropped = answers.citations(F.col("a"), F.col("n"))
    got = {r.id: (r.t, r.c, r.d) for r in df.select("id", text.alias("t"), cited.alias("c"), dropped.alias("d")).collect()}
    assert got == {
        1: ("Ohm [2] holds [1], and [2].", [2, 1], 0),
        2: ("None here.", [], 2),
        3: (None, [], 0),
        4: ("Two  blanks stay.", [], 0),
        5: ("bad good [1] ", [1], 2),
    }


def test_numbered_context(spark):
    df = spark.createDataFrame([(1, 2, "p. 3", "b"), (1, 1, None, "a"), (1, 3, "x", "c")], "q int, r int, w string, t string")
    got = answers.numbered_context(df, "q", "r", "w", "t", 2).first()
    assert got.n == 2 and got.context == "<<<CONTEXT 1 | >>>\na\n\n<<<CONTEXT 2 | p. 3>>>\nb"


def test_records_make_the_same_chunks_again(spark):
    meta = lambda **m: json.dumps(m)
    long = ". ".join(["one two three four five six seven eight nine ten"] * 150) + "."
    rows = [
        (1, "s", "A-1", "Short  text \n", meta(chapter_title=" ", chapter_name="Two", page_no="7", keywords=["a", " "])),
        (2, "s", "A-2", long, meta(page_no="x")),
        (3, "s", "A-1", "a copy of the locator", meta(chapter_title="One")),
        (4, "s", None, "no id", "{}"),
        (5, "s", "A-5", "  ", "{}"),
        (6, "gone", "A-6", "no document", "{}"),
        (7, "s", "A-7", "বাংলা লেখা", "not json"),
    ]
    rec = spark.createDataFrame(rows, "record_id long, source_document_id string, legacy_chunk_id string, content string, meta_json string")
    docs = spark.createDataFrame([("s", "f" * 64), ("n", None)], "source_document_id string, sha256 string")
    got = records.record_chunks(rec, docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.record_id, []).append(r)
    assert set(by) == {1, 2, 7} and len(by[2]) > 2
    assert (by[1][0].chapter, by[1][0].chapter_from, by[1][0].page, by[1][0].keywords) == ("Two", "chapter_name", 7, ["a"])
    assert by[1][0].text == "Short text" and by[1][0].status == "normalized" and by[2][0].page is None
    assert by[7][0].language == "bn" and by[7][0].status == "verbatim" and by[7][0].chunk_key.endswith(":legacy/A-7")
    assert {r.reason for r in records.rejected(rec).collect()} == {"no_chunk_id", "no_content"}
    plan = merge.merge_plan(got, records.record_chunks(rec, docs), ["chunk_id"], ["text", "chapter", "page", "tokens"])
    assert {r.action for r in plan.collect()} == {"unchanged"}
