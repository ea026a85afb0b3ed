import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import joins, merge, papers, parsing, retrieval
from inkwell.operators.ranks import spread_ranks
from inkwell.session import shared_folder, small_enough, staged
from inkwell.sources import files
from inkwell.operators.samples import hash_sample
from inkwell.session import clear_staged, folder_exists, list_folder, shared_folder, staged
from inkwell.streaming.ingest import MergeSink, merge_stream, windowed_counts


@pytest.mark.parametrize("span", [0, 10])
def test_asof_join_equals_brute_force(spark, span):
    rnd = random.Random(4)
    left = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(60)])) for i in range(120)]
    right = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(0, 60, 3)]), i) for i in range(60)]
    a = spark.createDataFrame(left, "id int, k string, at int")
    b = spark.createDataFrame(right, "k string, at int, v int")
    got = {r.id: r.v for r in joins.asof_join(a, b, ["k"], "at", ["v"], span=span).collect()}

    def best(k, at):
        ok = [(t, v) for q, t, v in right if k is not None and at is not None and q == k and t is not None and t <= at]
        return max(ok)[1] if ok else None

    assert got == {i: best(k, at) for i, k, at in left}


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(5)
    points = [(i, rnd.choice([1, 2, None]), rnd.choice([None, *range(-20, 40)])) for i in range(80)]
    spans = [(i, rnd.choice([1, 2, None]), lo, lo + rnd.randint(-2, 15)) for i in range(60) for lo in [rnd.randint(-20, 40)]]
    p = spark.createDataFrame(points, "p int, k int, x int")
    s = spark.createDataFrame(spans, "s int, k int, lo int, hi int")
    got = sorted((r.p, r.s) for r in joins.interval_join(p, s, ["k"], "x", "lo", "hi", width=7).collect())
    want = sorted((i, j) for i, k, x in points for j, q, lo, hi in spans if k is not None and k == q and x is not None and lo <= x <= hi)
    assert got == want


def test_spread_ranks_in_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    df = df.unionByName(spark.createDataFrame([(5000, None)], "id long, k string"))
    got = spread_ranks(df, ["k"], F.xxhash64("id"), "id").withColumn("h", F.xxhash64("id")).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.h, r.id, r["rank"]))
    assert None not in by and sum(map(len, by.values())) == 3000
    for rows in by.values():
        assert [x[2] for x in sorted(rows)] == list(range(len(rows)))


def test_merge_plan_and_apply(spark):
    stored = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, None), ("e", 1, "z")], "doc string, n int, v string")
    new = spark.createDataFrame([("d", 1, "a"), ("d", 2, "B"), ("d", 4, "d")], "doc string, n int, v string")
    plan = merge.merge_plan(stored, new, ["doc", "n"], ["v"])
    assert {(r.doc, r.n): r.action for r in plan.collect()} == {("d", 1): "unchanged", ("d", 2): "updated", ("d", 3): "pruned", ("d", 4): "created"}
    after = merge.apply_merge(stored, new, ["doc", "n"], plan)
    assert sorted(map(tuple, after.collect())) == [("d", 1, "a"), ("d", 2, "B"), ("d", 4, "d"), ("e", 1, "z")]
    again = merge.merge_plan(after, new, ["doc", "n"], ["v"])
    assert {r.action for r in again.collect()} == {"unchanged"}
    assert merge.merge_plan(stored, new.where("false"), ["doc", "n"], ["v"]).count() == 0


def test_questions_gaps_and_sub_parts(spark):
    text = "cover\n1 First?\n(a) this\n(2)\n(b) that\n(3)\n(Total for Question 1 = 5 marks)\n3 Third\n(Total for Question 3 = 1 mark)\nend"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, t string")
    q = [tuple(r) for r in parsing.terminated_questions(df, "id", "t").orderBy("ordinal").collect()]
    assert [(x[0], x[1], x[2], x[3]) for x in q] == [(1, 0, 1, 5), (1, 1, 3, 1)] and q[1][4] == "3 Third"
    lines = df.where("t is not null").select("id", F.posexplode(F.split("t", "\n", -1)).alias("n", "line"))
    parts = {r.label: (r.level, r.marks) for r in papers.nested_parts(lines, ["id"], ["n"]).collect()}
    assert parts == {"(a)": (1, 2), "(b)": (1, 3)}
    nums = spark.createDataFrame([("p", "1"), ("p", "3"), ("p", "x"), ("p", None), ("q", "2"), (None, "1")], "p string, n string")
    assert sorted((r.paper, r.found, r.highest, r.missing) for r in parsing.numbering_gaps(nums, "p", "n").collect()) == [("p", 2, 3, [2]), ("q", 1, 2, [1])]


def test_drop_between_and_pages(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate("a START b START c END d START e".split())], "k int, n int, l string")
    kept = [r.l for r in parsing.drop_between(lines, "k", "n", "l", "^START$", "^END$").orderBy("n").collect()]
    assert kept == ["a", "d"]
    pages = spark.createDataFrame([("d", 1, "abc"), ("d", 2, "de"), ("d", 3, "f")], "doc string, page int, text string")
    at = spark.createDataFrame([("d", i) for i in (0, 3, 4, 6, 7, 99)] + [("x", 0)], "doc string, at long")
    got = {(r.doc, r.at): r.page for r in parsing.page_of_offset(pages, at, "doc", "page", "text", "at").collect()}
    assert got == {("d", 0): 1, ("d", 3): 1, ("d", 4): 2, ("d", 6): 2, ("d", 7): 3, ("d", 99): 3, ("x", 0): None}


def test_retrieval_scopes_fuses_and_reranks(spark):
    docs = spark.createDataFrame([("a", "s1", "ohm law"), ("b", "s1", "ohm ohm"), ("c", "s2", "ohm law law")], "k string, scope string, t string")
    index = retrieval.postings(docs, "k", "scope", {"t": "C"})
    q = spark.createDataFrame([(1, "s1", "ohm"), (1, "s1", "law")], "q int, scope string, token string")
    got = [(r.k, r.score, r["rank"]) for r in retrieval.lexical(q, index, query="q", key="k", scope="scope").orderBy("rank").collect()]
    assert got == [("a", 0.4, 1), ("b", 0.4, 2)]
    vec = spark.createDataFrame([("a", "s1", [1.0, 0.0]), ("b", "s1", [0.0, 1.0]), ("z", "s1", [0.0, 0.0]), ("n", "s1", None), ("c", "s2", [1.0, 0.0])], "k string, scope string, v array<double>")
    ask = spark.createDataFrame([(1, "s1", [1.0, 0.1])], "q int, scope string, v array<double>")
    dense = retrieval.semantic(ask, vec, query="q", key="k", vector="v", scope="scope")
    assert [r.k for r in dense.orderBy("rank").collect()] == ["a", "b"]
    open_ = retrieval.semantic(ask.drop("scope").unionByName(ask.drop("scope").withColumn("q", F.lit(2))), vec, query="q", key="k", vector="v", send_rows=1)
    assert open_.count() == 6
    sparse = retrieval.lexical(q, index, query="q", key="k", scope="scope")
    langs = spark.createDataFrame([(1, "bn")], "q int, lang string")
    fused = {r.k: (r.fused, r.retrievers) for r in retrieval.fuse(dense, sparse, langs, query="q", key="k").collect()}
    assert fused["a"] == (round(0.4 / 61 + 0.6 / 61, 9), "semantic+lexical")
    scores = spark.createDataFrame([(1, "a", 0.1, 4), (1, "b", 0.1, 1)], "q int, k string, score double, priority int")
    order = retrieval.rerank(dense.select("q", "k", "rank"), scores, query="q", key="k").orderBy("rank").collect()
    assert [r.k for r in order] == ["b", "a"]
    assert retrieval.known_item(dense.withColumn("q", F.lit("b")), spark.createDataFrame([("b",), ("c",)], "q string"), query="q", key="k").first().mrr == 0.25


def test_json_lines_and_catalogue(spark, tmp_path):
    good = {"chunk_id": "1", "content": "x", "page_no": 3, "keywords": ["k"]}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good) + "\n")
    (tmp_path / "b.txt").write_text("no")
    assert files.strict_lines(spark, str(tmp_path)).where("content = 'x' and page_no = '3'").count() == 2
    (tmp_path / "c.jsonl").write_text('{"chunk_id": \n[1]\n{"content": "y"}\n')
    got = [(r.error, r.record and r.record.content) for r in files.tolerant_lines(spark, str(tmp_path)).where("file_name = 'c.jsonl'").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("parse", None), ("not_object", None), (None, "y")]))
    with pytest.raises(Exception):
        files.strict_lines(spark, str(tmp_path)).collect()
    cat = {r.name: r for r in files.file_catalogue(spark, str(tmp_path)).collect()}
    assert cat["b.txt"].bytes == 2 and cat["b.txt"].sha256 == hashlib.sha256(b"no").hexdigest() and len(cat) == 3
    pages = spark.createDataFrame([("d", p, "x" * 50) for p in range(1, 4)] + [("e", 1, "(cid:1)" * 20), ("e", 2, "")], "k string, p int, t string")
    assert {r.k: r.verdict for r in files.layer_verdict(pages, "k", "p", "t").collect()} == {"d": "text", "e": "ocr_required"}
    files.write_report(spark.range(2), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_staged_and_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) as s")
    assert staged(df).count() == 10 and staged(df.where("id > 99")).dtypes == df.dtypes
    assert small_enough(df, 10) and not small_enough(df, 9)
    assert shared_folder(spark) == shared_folder(spark)


def test_streaming_merge_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, at int")
    rows((1, "a", 1), (2, "b", 1), (1, "A", 2)).coalesce(1).write.parquet(str(src))
    sink = MergeSink(str(tmp_path / "table"), ["k"], ["v"], "at")
    where = str(tmp_path / "cp")
    read = lambda: spark.readStream.schema("k int, v string, at int").parquet(str(src))
    merge_stream(read(), sink, where).awaitTermination()
    rows((2, "B", 3), (3, "c", 3)).coalesce(1).write.mode("append").parquet(str(src))
    merge_stream(read(), sink, where).awaitTermination()
    assert sorted((r.k, r.v) for r in sink.current(spark).collect()) == [(1, "A"), (2, "B"), (3, "c")]
    n = len(sink.versions(spark))
    sink(rows((1, "again", 9)), sink.versions(spark)[-1])
    assert len(sink.versions(spark)) == n and sink.current(spark).where("v = 'again'").count() == 0
    before = {p.split("/")[-2] for p in sink.parts(spark).values()}
    sink(rows((3, "C", 9)), 99)  # writes the part of its key only
    assert [p for p in sink.parts(spark).values() if "/v99/" in p] == [p for b, p in sink.parts(spark).items() if "/v99/" in p][:1]
    assert before & {p.split("/")[-2] for p in sink.parts(spark).values()}
    assert sink.drop_old(spark) > 0 and sorted((r.k, r.v) for r in sink.current(spark).collect()) == [(1, "A"), (2, "B"), (3, "C")]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "click", 1.0), ("2024-01-01 00:02:00", "click", 2.0)], "ts string, event_type string, value double")
    got = windowed_counts(events.withColumn("ts", F.to_timestamp("ts"))).collect()
    assert [(r.events, r.value) for r in got] == [(2, 3.0)]


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/x/"}
    assert shared_folder(Session()) == "hdfs://shared/x"


def test_staged_frames_can_be_removed(spark):
    clear_staged(spark)
    a, b = staged(spark.range(5)), staged(spark.range(0))
    assert a.count() == 5 and b.count() == 0 and b.columns == ["id"]
    where = a.inputFiles()[0].rsplit("/", 1)[0]
    assert folder_exists(spark, where) and list_folder(spark, where)
    assert clear_staged(spark) == 2 and not folder_exists(spark, where) and list_folder(spark, where) == []


def test_hash_sample_is_bounded_and_the_same_in_any_order(spark):
    df = spark.range(20_000, numPartitions=7)
    h = F.xxhash64("id")
    got = {r.id for r in hash_sample(df, h, 500, 20_000).collect()}
    assert len(got) == 500 and got == {r.id for r in hash_sample(df.repartition(3), h, 500, 20_000).collect()}
    assert hash_sample(df.limit(20), h, 500, 20).count() == 20 and hash_sample(df.where("false"), h, 500, 0).count() == 0
