"""Retrieval: terms, lexical and vector lists, fusion, rerank and known-item evaluation.

The query set of every search is the rows whose id is divisible by 100; every row is searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators import answers as A
from inkwell.operators import retrieval as R
from inkwell.session import staged
from inkwell.sources.tables import table

_STOPS = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
_QWORD = "[A-Za-z\\x{0980}-\\x{09FF}]{4,}"


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    words = docs.select("doc_id", F.explode(R.tokens(F.col("text"), R.QUERY_WORD)).alias("word")).where(~F.col("word").isin(R.STOP_WORDS))
    times = words.groupBy("word").agg(F.count("*").alias("times"))
    return R.document_frequencies(docs, "text").join(times, "word").select("word", F.col("df").alias("texts"), "times")


_TF = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_QWORD}')) AS word FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word NOT IN ({_STOPS}) GROUP BY 1, 2)"""
DOCUMENT_FREQUENCY = f"WITH {_TF} SELECT word, count(*) AS texts, CAST(sum(tf) AS BIGINT) AS times FROM tf GROUP BY 1"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    counts = staged(R.term_counts(docs.where("doc_id % 100 = 0"), "doc_id", "text"), "counts")
    return R.distinctive_terms(counts, R.document_frequencies(docs, "text", counts), "doc_id", docs.count())


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """The distinctive words of the query documents, in order."""
    t = _terms(spark, d)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ")
    return t.groupBy("doc_id").agg(joined.alias("query"))


_TERMS = f"""{_TF}, df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
sc AS (SELECT tf.doc_id, tf.word, round(tf.tf * ln(n.n / (1.0 + df.df)), 9) AS score FROM tf JOIN df ON df.word = tf.word, n WHERE tf.doc_id % 100 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM sc),
terms AS (SELECT doc_id, word, rank FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM rk WHERE rank <= 8) WHERE c >= 4)"""
QUERY_TERMS = f"WITH {_TERMS} SELECT doc_id, string_agg(word, ' ' ORDER BY rank) AS query FROM terms GROUP BY 1"


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("domain", F.lit("-")).alias("domain"), "text", "chunk_type")
    asked = _terms(spark, d).join(docs.select("doc_id", "domain"), "doc_id").select(F.col("doc_id").alias("query_id"), "domain", F.col("word").alias("token"))
    asked = staged(asked, "asked")
    index = R.postings(docs, "doc_id", "domain", {"text": "C", "chunk_type": "A"}, asked)
    return R.lexical(asked, index, query="query_id", key="doc_id", scope="domain")


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """The 30 best documents of the same domain for each query, by summed field weights of matching words."""
    return _lexical(spark, d).select("query_id", "doc_id", "score", "rank")


_TOKEN = "[\\pL\\pN][\\pL\\pM\\pN]*"
_LEX = f"""{_TERMS}, dd AS (SELECT doc_id, coalesce(domain, '-') AS domain, text, chunk_type FROM documents WHERE text IS NOT NULL),
po AS (SELECT doc_id, domain, token, round(sum(w), 6) AS weight FROM (SELECT doc_id, domain, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token, 0.2 AS w FROM dd
  UNION ALL SELECT doc_id, domain, unnest(regexp_extract_all(lower(chunk_type), '{_TOKEN}')), 1.0 FROM dd) GROUP BY 1, 2, 3),
hit AS (SELECT t.doc_id AS query_id, po.doc_id, CAST(round(sum(po.weight), 6) AS DOUBLE) AS score FROM terms t JOIN dd ON dd.doc_id = t.doc_id JOIN po ON po.domain = dd.domain AND po.token = t.word GROUP BY 1, 2),
lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hit)"""
LEXICAL_SEARCH = f"WITH {_LEX} SELECT query_id, doc_id, score, rank FROM lex WHERE rank <= 30"


def known_item(spark: SparkSession, d: str) -> DataFrame:
    """How often the lexical search finds the very document a query was made from."""
    asked = _terms(spark, d).select(F.col("doc_id").alias("query_id")).distinct()
    return R.known_item(_lexical(spark, d), asked, query="query_id", key="doc_id")


KNOWN_ITEM = f"""WITH {_LEX}, a AS (SELECT DISTINCT doc_id AS query_id FROM terms), p AS (SELECT a.query_id, lex.rank AS place FROM a LEFT JOIN lex ON lex.query_id = a.query_id AND lex.doc_id = a.query_id AND lex.rank <= 30)
SELECT count(*) AS evaluated, round_even(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round_even(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_k,
  round_even(avg(coalesce(1.0 / place, 0.0)), 4) AS mrr, coalesce(round_even(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 4) >= 0.8, false) AS passed FROM p"""


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The 30 most similar vectors for each query vector, the query itself included."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.semantic(asked, e, query="query_id", key="vec_id", vector="embedding").select("query_id", "vec_id", "score", "rank")


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"
VECTOR_SEARCH = f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 30
"""


def _hybrid_parts(spark: SparkSession, d: str):
    chunks = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).where("text is not null")
    chunks = chunks.select("chunk_id", "offering_id", "text", F.coalesce("topic", F.lit("")).alias("topic"), "language")
    v = table(spark, d, "chunk_vectors").where("vector is not null and size(vector) = 128 and not exists(vector, x -> x is null or isnan(x))")
    asked = v.where("vec_id % 100 = 0").select("vec_id", "chunk_id", "vector")
    v = v.groupBy("chunk_id").agg(F.min_by("vector", "vec_id").alias("vector"))
    placed = v.join(chunks.select("chunk_id", "offering_id"), "chunk_id")
    queries = staged(asked.join(chunks, "chunk_id").select(F.col("vec_id").alias("query_id"), F.col("chunk_id").alias("own"), "offering_id", "vector", "text", "language"), "queries")
    dense = R.semantic(queries, placed, query="query_id", key="chunk_id", vector="vector", scope="offering_id")
    counts = staged(R.term_counts(queries.select(F.col("own").alias("chunk_id"), "text").distinct(), "chunk_id", "text"), "counts")
    terms = R.distinctive_terms(counts, R.document_frequencies(chunks, "text", counts), "chunk_id", chunks.count())
    words = queries.join(terms, F.col("own") == F.col("chunk_id")).select("query_id", "offering_id", F.col("word").alias("token"))
    words = staged(words, "asked")
    index = R.postings(chunks, "chunk_id", "offering_id", {"text": "C", "topic": "A"}, words)
    sparse = R.lexical(words, index, query="query_id", key="chunk_id", scope="offering_id")
    langs = queries.select("query_id", "own", F.col("offering_id").alias("scope"), F.when(F.col("text").rlike("[\\u0980-\\u09FF]"), "bn").otherwise("en").alias("lang"))
    return dense, sparse, langs


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Eight chunks of the query's offering per query chunk, fused from a vector and a lexical list by reciprocal rank."""
    dense, sparse, langs = _hybrid_parts(spark, d)
    return R.fuse(dense, sparse, langs.select("query_id", "lang"), query="query_id", key="chunk_id")


def hybrid_known_item(spark: SparkSession, d: str) -> DataFrame:
    """How often the fused list of a chunk's own words and vector has that chunk first, and among its first five."""
    dense, sparse, langs = _hybrid_parts(spark, d)
    fused = R.fuse(dense, sparse, langs.select("query_id", "lang"), query="query_id", key="chunk_id", limit=5)
    return R.known_item(fused, langs.select("query_id", "own"), query="query_id", key="chunk_id")


def lexical_known_item(spark: SparkSession, d: str) -> DataFrame:
    """The same for the lexical list of the chunks alone, over the queries that have words of their own."""
    _, sparse, langs = _hybrid_parts(spark, d)
    asked = langs.join(sparse.select("query_id").distinct(), "query_id", "left_semi")
    return R.known_item(sparse, asked.select("query_id", "own"), query="query_id", key="chunk_id")


def retrieval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What each retriever had for each query of the hybrid search."""
    dense, sparse, langs = _hybrid_parts(spark, d)
    fused = R.fuse(dense, sparse, langs.select("query_id", "lang"), query="query_id", key="chunk_id")
    v = table(spark, d, "chunk_vectors").where("vector is not null and size(vector) = 128 and not exists(vector, x -> x is null or isnan(x))").select("chunk_id").distinct()
    c = table(spark, d, "chunks").where("text is not null").select("chunk_id", F.col("offering_id").alias("scope")).dropDuplicates(["chunk_id"])
    there = v.join(c, "chunk_id").groupBy("scope").agg(F.count("*").alias("embedded"))
    return R.diagnostics(dense, sparse, fused, langs, there, query="query_id")


def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees of each hybrid result: where it stands, never its text."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "offering_id", "source_document_id", "question_number", "page_number", "section_ref")
    o = table(spark, d, "subject_offerings").select("offering_id", F.col("slug").alias("offering"))
    s = table(spark, d, "source_documents").select("source_document_id", F.col("title").alias("document"), "paper_code")
    rows = hybrid_search(spark, d).select("query_id", "rank", "chunk_id").join(c, "chunk_id").join(o, "offering_id").join(s, "source_document_id", "left")
    return rows.select("query_id", "rank", "chunk_id", "offering", "document", "paper_code", "question_number", F.col("page_number").alias("page"), F.col("section_ref").alias("section"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """The six best chunks of each hybrid query as one numbered block, by its checksum."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "text", "section_ref")
    rows = hybrid_search(spark, d).select("query_id", "rank", "chunk_id").join(c, "chunk_id")
    block = A.numbered_context(rows, "query_id", "rank", "section_ref", "text", 6)
    return block.select("query_id", "n", F.sha2(F.encode("context", "utf-8"), 256).alias("sha256"))


_HYBRID = f"""ch AS (SELECT DISTINCT chunk_id, offering_id, text, coalesce(topic, '') AS topic, language FROM chunks WHERE text IS NOT NULL),
vv AS (SELECT * FROM chunk_vectors WHERE vector IS NOT NULL AND len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0),
v1 AS (SELECT chunk_id, arg_min(vector, vec_id) AS vector FROM vv GROUP BY 1), pl AS (SELECT v1.chunk_id, v1.vector, ch.offering_id FROM v1 JOIN ch ON ch.chunk_id = v1.chunk_id),
q AS (SELECT vv.vec_id AS query_id, ch.chunk_id AS own, ch.offering_id, vv.vector, ch.text, CASE WHEN regexp_matches(ch.text, '[\\x{{0980}}-\\x{{09FF}}]') THEN 'bn' ELSE 'en' END AS lang FROM vv JOIN ch ON ch.chunk_id = vv.chunk_id WHERE vv.vec_id % 100 = 0),
ds AS (SELECT q.query_id, pl.chunk_id, round({_COS.format(a='pl.vector', b='q.vector')}, 6) AS score FROM q JOIN pl ON pl.offering_id = q.offering_id),
dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds WHERE score IS NOT NULL AND NOT isnan(score)),
w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '{_QWORD}')) AS word FROM ch), tf AS (SELECT chunk_id, word, count(*) AS tf FROM w WHERE word NOT IN ({_STOPS}) GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM ch),
sc AS (SELECT tf.chunk_id, tf.word, round(tf.tf * ln(n.n / (1.0 + df.df)), 9) AS score FROM tf JOIN df ON df.word = tf.word, n WHERE tf.chunk_id IN (SELECT own FROM q)),
tr AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, word) AS k FROM sc) WHERE k <= 8) WHERE c >= 4),
po AS (SELECT chunk_id, offering_id, token, round(sum(w), 6) AS weight FROM (SELECT chunk_id, offering_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token, 0.2 AS w FROM ch
  UNION ALL SELECT chunk_id, offering_id, unnest(regexp_extract_all(lower(topic), '{_TOKEN}')), 1.0 FROM ch) GROUP BY 1, 2, 3),
ls AS (SELECT q.query_id, po.chunk_id, round(sum(po.weight), 6) AS score FROM q JOIN tr ON tr.chunk_id = q.own JOIN po ON po.offering_id = q.offering_id AND po.token = tr.word GROUP BY 1, 2),
sparse AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ls),
fu AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank FROM (SELECT * FROM dense WHERE rank <= 30) d FULL OUTER JOIN (SELECT * FROM sparse WHERE rank <= 30) s ON s.query_id = d.query_id AND s.chunk_id = d.chunk_id),
sf AS (SELECT fu.query_id, fu.chunk_id, CAST(round(coalesce((CASE WHEN lang = 'bn' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END) / (60 + dense_rank), 0.0) + coalesce((CASE WHEN lang = 'bn' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END) / (60 + sparse_rank), 0.0), 9) AS DOUBLE) AS fused,
  CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank, concat_ws('+', CASE WHEN dense_rank IS NOT NULL THEN 'semantic' END, CASE WHEN sparse_rank IS NOT NULL THEN 'lexical' END) AS retrievers FROM fu JOIN q ON q.query_id = fu.query_id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS INTEGER) AS rank FROM sf)"""
HYBRID_SEARCH = f"WITH {_HYBRID} SELECT query_id, chunk_id, fused, dense_rank, sparse_rank, retrievers, rank FROM fused WHERE rank <= 8"


HYBRID_KNOWN_ITEM = f"""WITH {_HYBRID}, p AS (SELECT q.query_id, f.rank AS place FROM q LEFT JOIN fused f ON f.query_id = q.query_id AND f.chunk_id = q.own AND f.rank <= 5)
SELECT count(*) AS evaluated, round_even(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round_even(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_k,
  round_even(avg(coalesce(1.0 / place, 0.0)), 4) AS mrr, coalesce(round_even(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 4) >= 0.8, false) AS passed FROM p"""
LEXICAL_KNOWN_ITEM = f"""WITH {_HYBRID}, p AS (SELECT q.query_id, f.rank AS place FROM q LEFT JOIN sparse f ON f.query_id = q.query_id AND f.chunk_id = q.own AND f.rank <= 30
  WHERE q.query_id IN (SELECT query_id FROM sparse))
SELECT count(*) AS evaluated, round_even(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round_even(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_k,
  round_even(avg(coalesce(1.0 / place, 0.0)), 4) AS mrr, coalesce(round_even(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 4) >= 0.8, false) AS passed FROM p"""
RETRIEVAL_DIAGNOSTICS = f"""WITH {_HYBRID}, e AS (SELECT offering_id, count(*) AS embedded FROM pl GROUP BY 1), r AS (
  SELECT q.query_id, q.lang, (SELECT count(*) FROM sparse s WHERE s.query_id = q.query_id AND s.rank <= 30) AS lexical_found, (SELECT count(*) FROM dense x WHERE x.query_id = q.query_id AND x.rank <= 30) AS semantic_found,
    coalesce(e.embedded, 0) AS embedded, (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id AND f.rank <= 8) AS candidates FROM q LEFT JOIN e ON e.offering_id = q.offering_id)
SELECT *, concat_ws('; ', CASE WHEN embedded = 0 THEN 'no vectors in scope' END, CASE WHEN candidates = 0 THEN 'nothing found' END) AS notes FROM r"""
CITATION_ROWS = f"""WITH {_HYBRID}, c AS (SELECT DISTINCT ON (chunk_id) chunk_id, offering_id, source_document_id, question_number, page_number, section_ref FROM chunks)
SELECT f.query_id, f.rank, f.chunk_id, o.slug AS offering, s.title AS document, s.paper_code, c.question_number, c.page_number AS page, c.section_ref AS section
FROM fused f JOIN c ON c.chunk_id = f.chunk_id JOIN subject_offerings o ON o.offering_id = c.offering_id LEFT JOIN source_documents s ON s.source_document_id = c.source_document_id WHERE f.rank <= 8"""
CONTEXTS = f"""WITH {_HYBRID}, c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text, section_ref FROM chunks)
SELECT f.query_id, count(*) AS n, sha256(string_agg('<<<CONTEXT ' || f.rank || ' | ' || coalesce(c.section_ref, '') || '>>>' || chr(10) || coalesce(c.text, ''), chr(10) || chr(10) ORDER BY f.rank)) AS sha256
FROM fused f JOIN c ON c.chunk_id = f.chunk_id WHERE f.rank <= 6 GROUP BY 1"""


def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The vector list of each query reordered in its first 20 by similarity plus a bonus for the label as priority."""
    e = table(spark, d, "embeddings")
    ranked = vector_search(spark, d)
    scores = ranked.join(e.select("vec_id", (F.col("label") % 4 + 1).alias("priority")), "vec_id").select("query_id", "vec_id", "score", "priority")
    return R.rerank(ranked.select("query_id", "vec_id", "rank"), scores, query="query_id", key="vec_id")


RERANKED_SEARCH = f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label % 4 + 1 AS priority, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS before FROM s), t AS (SELECT *, round(score + 0.02 * (4 - priority), 9) AS value FROM r WHERE before <= 30)
SELECT query_id, vec_id, CAST(before AS INTEGER) AS before, CAST(row_number() OVER (PARTITION BY query_id ORDER BY before <= 20 DESC, CASE WHEN before <= 20 THEN -value ELSE CAST(before AS DOUBLE) END, vec_id) AS INTEGER) AS rank FROM t
"""


def question_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each question of a paper (offering, paper code, number): the chunk of the question itself, then its mark schemes,
    by the paper code of the chunk's document; numbers in their numeric order."""
    s = table(spark, d, "source_documents").where("paper_code is not null").select("source_document_id", "paper_code")
    of = table(spark, d, "source_documents").select("source_document_id", "offering_id")
    q = table(spark, d, "parsed_questions").where("question_number is not null")
    q = q.join(of, "source_document_id").select("offering_id", "paper_code", "question_number").where("paper_code is not null").distinct()
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).where("chunk_type in ('exam_question', 'mark_scheme_answer') and question_number is not null")
    c = c.join(s, "source_document_id").select("chunk_id", "offering_id", "paper_code", "question_number", "chunk_type")
    met = q.join(c, ["offering_id", "paper_code", "question_number"])
    w = Window.partitionBy("offering_id", "paper_code", "question_number").orderBy(F.when(F.col("chunk_type") == "exam_question", 0).otherwise(1), "chunk_id")
    order = F.when(F.col("question_number").rlike("^[0-9]+$"), F.col("question_number").try_cast("int")).otherwise(9999)
    return met.select("offering_id", "paper_code", "question_number", order.cast("int").alias("place"), "chunk_id", "chunk_type", F.row_number().over(w).alias("rank"))


QUESTION_LOOKUP = """
WITH q AS (SELECT DISTINCT s.offering_id, q.paper_code, q.question_number FROM parsed_questions q JOIN source_documents s ON s.source_document_id = q.source_document_id WHERE q.question_number IS NOT NULL AND q.paper_code IS NOT NULL),
c AS (SELECT DISTINCT c.chunk_id, c.offering_id, s.paper_code, c.question_number, c.chunk_type FROM chunks c JOIN source_documents s ON s.source_document_id = c.source_document_id WHERE c.chunk_type IN ('exam_question', 'mark_scheme_answer'))
SELECT q.offering_id, q.paper_code, q.question_number, CASE WHEN regexp_matches(q.question_number, '^[0-9]+$') THEN CAST(q.question_number AS INTEGER) ELSE 9999 END AS place, c.chunk_id, c.chunk_type,
  CAST(row_number() OVER (PARTITION BY q.offering_id, q.paper_code, q.question_number ORDER BY CASE WHEN c.chunk_type = 'exam_question' THEN 0 ELSE 1 END, c.chunk_id) AS INTEGER) AS rank
FROM q JOIN c ON c.offering_id = q.offering_id AND c.paper_code = q.paper_code AND c.question_number = q.question_number
"""


def query_map() -> dict:
    return {
        "document_frequency": (document_frequency, DOCUMENT_FREQUENCY),
        "query_terms": (query_terms, QUERY_TERMS),
        "lexical_search": (lexical_search, LEXICAL_SEARCH),
        "known_item": (known_item, KNOWN_ITEM),
        "vector_search": (vector_search, VECTOR_SEARCH),
        "hybrid_search": (hybrid_search, HYBRID_SEARCH),
        "hybrid_known_item": (hybrid_known_item, HYBRID_KNOWN_ITEM),
        "lexical_known_item": (lexical_known_item, LEXICAL_KNOWN_ITEM),
        "retrieval_diagnostics": (retrieval_diagnostics, RETRIEVAL_DIAGNOSTICS),
        "citation_rows": (citation_rows, CITATION_ROWS),
        "contexts": (contexts, CONTEXTS),
        "reranked_search": (reranked_search, RERANKED_SEARCH),
        "question_lookup": (question_lookup, QUESTION_LOOKUP),
    }
