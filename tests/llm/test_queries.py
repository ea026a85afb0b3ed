import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell.llm import queries as Q

FOUND = {
    "p2_found": {"vec_lo": "bigint", "vec_hi": "bigint"},
    "p3_found": {"tbl": "string", "row_key": "string", "kind": "string", "lang": "string"},
    "p4_found": {"first_id": "bigint", "other_id": "bigint"},
    "p5_found": {"tbl": "string", "row_key": "string", "line_no": "int", "kind": "string"},
    "p6_found": {"tbl": "string", "first_key": "string", "second_key": "string"},
    "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_runs_and_rows_are_distinct(spark, folder, name):
    df = Q.queries()[name](spark, folder)
    if name in FOUND:
        assert dict(df.dtypes) == FOUND[name]
        rows = df.collect()
        assert len(rows) == len(set(rows))
    else:
        assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("chunk_vectors", "legacy_records"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []


def test_packing_and_mixing_keep_what_they_promise(spark, folder):
    """Every text in its containers whole, no container over its capacity, the report's totals those of the texts."""
    packed = Q.queries()["p7_pack_short"](spark, folder)
    sizes = Q._sized(spark, folder).where("tokens > 0 and doc_id is not null")
    cap = Q._capacity(spark, folder, "short window")
    assert packed.groupBy("container").agg(F.sum("tokens").alias("n")).where(F.col("n") > cap).count() == 0
    whole = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    assert whole.select("doc_id", "tokens").exceptAll(sizes.select("doc_id", "tokens")).count() == 0 and whole.count() == sizes.count()
    assert whole.where(F.col("pieces") != F.ceil(F.col("tokens") / cap)).count() == 0
    total = sizes.agg(F.sum("tokens")).first()[0]
    for r in Q.p7_report(spark, folder).collect():
        assert r.tokens == total and r.least <= r.containers and r.lp_containers <= r.containers and r.lp_gap <= 0.05
    shares = Q.p8_shares(spark, folder).collect()
    drawn = sum(r.tokens for r in shares)
    assert abs(sum(r.share for r in shares) - 1) < 1e-9 and all(r.most_used <= r.max_repeats and abs(r.tokens - r.share * drawn) < 1 for r in shares)


def test_recall_of_the_index(spark):
    rows = Q.p2_recall(spark, "/root/testdata/sf0.1").collect()
    assert {r.band for r in rows} >= {"0.90", "below"}
    for r in rows:
        assert r.found_neighbours >= 0.9 * r.exact_neighbours > 0
