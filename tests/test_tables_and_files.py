import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import paths as H
from inkwell.operators import retrieval as R
from inkwell.operators import tables as T
from inkwell.sources import files


def test_optional_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert T.only(df).count() == 3 and T.only(df, v=None).count() == 3 and T.only(df, v="a", k=2).count() == 0
    assert {r.k for r in T.only(df, v=["a", "b"]).collect()} == {1, 2} and T.only(df, v=[]).count() == 0


def test_has_any_remapped_and_backfilled(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    other = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    assert {(r.v, r.there) for r in T.has_any(df, other, ["k"], "there").collect()} == {(1, True), (2, False), (3, False)}
    assert [r.k for r in df.select(T.remapped(F.col("k"), {"x": "z"}).alias("k")).collect()] == ["z", "y", None]
    seen = spark.createDataFrame([("x", 1), ("y", 9), ("y", 9), ("q", 4)], "k string, v int")
    assert sorted(((r.k or "", r.v, r.changed) for r in T.backfilled(df, seen, ["k"], "v").collect())) == [("", 3, False), ("x", 1, False), ("y", 9, True)]


def test_catalogue_mismatches(spark):
    docs = spark.createDataFrame(
        [("same", "s1", 3, "text"), ("gone", "s9", 3, "text"), ("pages", "s2", 4, "text"), ("route", "s3", None, "ocr"), ("both", "s2", 5, "ocr"), ("none", None, 3, "text"), ("lacks", "s4", 2, "text")],
        "source_document_id string, sha256 string, page_count int, ingestion_route string",
    )
    cat = spark.createDataFrame([("s1", 3, "text"), ("s1", 3, "text"), ("s2", 3, "text"), ("s3", 8, "text"), ("s4", None, None), (None, 1, "ocr")], "sha256 string, pages int, verdict string")
    got = {(r.source_document_id, r.problem) for r in T.catalogue_mismatches(docs, cat).collect()}
    assert got == {("gone", "not_in_catalogue"), ("pages", "other_pages"), ("route", "other_route"), ("both", "other_pages"), ("both", "other_route"), ("lacks", "other_pages")}


def test_runs_are_added(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "n int")
    T.append_run(df, str(tmp_path / "runs"), "one")
    T.append_run(df.unionByName(df), str(tmp_path / "runs"), "two")
    assert {r.run: r["count"] for r in spark.read.parquet(str(tmp_path / "runs")).groupBy("run").count().collect()} == {"one": 1, "two": 2}


def test_paths(spark):
    rows = [
        ("phy/Question-Paper/2023 winter/abc12-que-2023.pdf", ("phy", "past_paper", 1, 2023, "winter", "ABC12")),
        ("phy/misc/abc13-rms-20.pdf", ("phy", "mark_scheme", 1, None, None, "ABC13")),
        ("phy/misc/x-pef.pdf", ("phy", "examiner_report", 1, None, None, None)),
        ("textbooks/a.pdf", ("textbooks", "textbook", 2, None, None, None)),
        ("queue.pdf", (None, "unknown", None, None, None, None)),
    ]
    df = spark.createDataFrame([(p,) for p, _ in rows], "p string")
    year, series = H.session(F.col("p"))
    cols = [H.subject_folder(F.col("p")), H.document_type(F.col("p")), H.source_priority(F.col("p")), year, series, H.paper_code(F.col("p"), ["abc12", "abc13"])]
    assert [tuple(r) for r in df.select(*[c.alias(str(i)) for i, c in enumerate(cols)]).collect()] == [w for _, w in rows]
    t = spark.createDataFrame([("mark_scheme", "ABC1", 2, 2020, "summer"), ("textbook", None, None, None, None), (None, "Q", None, 2021, None)], "k string, c string, u int, y int, s string")
    assert [r[0] for r in t.select(H.title_of(*[F.col(c) for c in "kcuys"])).collect()] == ["Mark scheme — ABC1 Unit 2 2020 summer", "textbook —", "Document — Q 2021"]


def test_files(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"documents": [{"sha256": "a", "pages": 3}]}, indent=2))
    assert files.json_document(spark, str(tmp_path / "doc.json")).select(F.explode("documents.pages")).first()[0] == 3
    df = spark.createDataFrame([(None, "b", 2), ("a|x", None, 1)], "content string, answer string, n int")
    assert [r.text for r in files.first_text(df, ["content", "text", "answer"]).collect()] == ["b", "a|x"]
    report = files.markdown_table(df.select("n", "content"))
    assert report == "| n | content |\n| ---: | --- |\n| 1 | a\\|x |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        files.markdown_table(df, most=1)
    where = tmp_path / "report.md"
    assert files.is_stale(spark, str(where), report)
    where.write_text(report)
    assert not files.is_stale(spark, str(where), report) and files.is_stale(spark, str(where), report + "x")
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "1", "content": "x"}\n\n[1]\nnot json\n')
    got = sorted((r.raw, r.error or "") for r in files.tolerant_lines(spark, str(tmp_path)).collect())
    assert got == [("[1]", "not_object"), ("not json", "parse"), ('{"chunk_id": "1", "content": "x"}', "")]


def test_layer_verdicts_look_at_eight_pages_at_most(spark):
    good, bad = "letters enough to be read as a page of text, surely", "(cid:1)(cid:2)(cid:3) some words (cid:4)(cid:5)(cid:6)(cid:7)"
    rows = [("a", i, good) for i in range(20)] + [("b", i, "" if i else None) for i in range(3)] + [("c", 1, good), ("c", 2, bad), ("d", 1, "short"), (None, 1, good)]
    got = {r.k: (r.pages, r.sampled, r.good, r.garbled, r.empty, r.verdict) for r in files.layer_verdict(spark.createDataFrame(rows, "k string, p int, t string"), "k", "p", "t").collect()}
    assert got == {"a": (20, 8, 8, 0, 0, "text"), "b": (3, 3, 0, 0, 3, "ocr_required"), "c": (2, 2, 1, 1, 0, "mixed"), "d": (1, 1, 0, 1, 0, "ocr_required")}


def test_diagnostics_and_known_items(spark):
    q = spark.createDataFrame([(1, "en", "s"), (2, "bn", "t")], "query int, lang string, scope string")
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, key string, rank int")
    there = spark.createDataFrame([("s", 7)], "scope string, embedded long")
    rows = {r["query"]: r for r in R.diagnostics(lists, lists.where("rank = 1"), lists, q, there, query="query").collect()}
    assert (rows[1].semantic_found, rows[1].lexical_found, rows[1].embedded, rows[1].candidates, rows[1].notes) == (2, 1, 7, 2, "")
    assert (rows[2].semantic_found, rows[2].embedded, rows[2].notes) == (0, 0, "no vectors in scope; nothing found")
    asked = spark.createDataFrame([(1, "b"), (2, "x")], "query int, own string")
    r = R.known_item(lists, asked, query="query", key="key").first()
    assert (r.evaluated, r.recall_at_1, r.recall_at_k, r.mrr, r.passed) == (2, 0.0, 0.5, 0.25, False)
    assert R.known_item(lists.where("false"), asked.where("false"), query="query", key="key").first().passed is False


def test_postings_of_asked_tokens_only(spark):
    df = spark.createDataFrame([(1, "s", "Ohm law ohm", "law"), (2, "s", "gas", None)], "k int, s string, t string, u string")
    asked = spark.createDataFrame([("ohm",), ("law",), ("ohm",)], "token string")
    got = {(r.k, r.token): r.weight for r in R.postings(df, "k", "s", {"t": "C", "u": "A"}, asked).collect()}
    assert got == {(1, "ohm"): 0.4, (1, "law"): 1.2}
    assert {(r.k, r.token) for r in R.postings(df, "k", "s", {"t": "C", "u": "A"}).collect()} == {*got, (2, "gas")}
