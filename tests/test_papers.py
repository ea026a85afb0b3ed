"""Paper and mark-scheme parsing on small pages with known answers, and against a plain reading line by line."""

import random
import re

from inkwell.operators import papers as P

PAGES = [
    (1, "Answer ALL questions.\n1 Which unit is that of force?\nA newton\nB joule\n(Total for Question 1 = 1 mark)\nDO\nNOT\nWRITE\nIN\nTHIS\nAREA\n2 Which is a vector?\nA mass\nB velocity\n(total for question 2 =  1 marks )\n*X00000A0000*\n12"),
    (2, "3 A ball falls ..........\n(a) Name the force.\n(2)\n(b) The ball stops.\n  (i) State why.\n(3)\n(ii) Give the time.\n..............\naera siht ni etirw ton od\n(2)\n\n\n\nEnd of it\n(Total for Question 3 = 7 marks)\nTurn over"),
]


def _frame(spark, pages, doc="d"):
    return spark.createDataFrame([(doc, p, t) for p, t in pages], "doc string, page int, text string")


def test_questions_of_a_paper(spark):
    df = _frame(spark, PAGES)
    got = sorted(P.paper_questions(df, "doc", "page", "text").collect(), key=lambda r: r.ordinal)
    assert [(r.question_number, r.marks, r.page_start, r.page_end) for r in got] == [("1", 1, 1, 1), ("2", 1, 1, 1), ("3", 7, 1, 2)]
    assert got[0].text == "1 Which unit is that of force?\nA newton\nB joule" and got[1].text == "2 Which is a vector?\nA mass\nB velocity"
    assert got[2].text == "3 A ball falls\n(a) Name the force.\n(2)\n(b) The ball stops.\n  (i) State why.\n(3)\n(ii) Give the time.\n(2)\n\nEnd of it"
    assert P.paper_questions(_frame(spark, [(1, "no total here"), (2, None), (3, "")]), "doc", "page", "text").count() == 0
    assert P.paper_questions(df.where("false"), "doc", "page", "text").count() == 0


def _parts(spark, df):
    from pyspark.sql import functions as F

    q = P.paper_questions(df, "doc", "page", "text")
    lines = q.select("doc", "ordinal", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return q, P.nested_parts(lines, ["doc", "ordinal"], ["n"])


def test_nested_parts_and_the_report(spark):
    q, parts = _parts(spark, _frame(spark, PAGES))
    got = sorted((r.ordinal, r.place, r.label, r.level, r.marks) for r in parts.collect())
    assert got == [(2, 0, "(a)", 1, 2), (2, 1, "(b)", 1, None), (2, 2, "(b)(i)", 2, 3), (2, 3, "(b)(ii)", 2, 2)]
    r = P.paper_report(q, parts).first()
    assert (r.questions, r.marks, r.missing, r.part_counts) == (3, 9, [], {"1": 0, "2": 0, "3": 4})
    gap = _frame(spark, [(1, "1 One\n(Total for Question 1 = 2 marks)\n3 Three\n(Total for Question 3 = 4 marks)")])
    assert P.paper_report(*_parts(spark, gap)).first().missing == [2]


def _plain_parts(text):
    """The nesting rule read line by line."""
    out, level_one, now = [], None, None
    for line in text.split("\n"):
        roman, letter = re.match(P.NUMERAL, line), re.match(P.PART, line)
        if roman and (len(roman[1]) > 1 or level_one is not None):
            now = [f"{level_one or ''}({roman[1]})", 2, None]
            out.append(now)
        elif letter:
            level_one = f"({letter[1]})"
            now = [level_one, 1, None]
            out.append(now)
        elif (m := re.match(P.PART_MARKS, line)) and now is not None and now[2] is None:
            now[2] = int(m[1])
    return [tuple(x) for x in out]


def test_nesting_equals_a_plain_reading(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    pool = ["(a) x", "(b) y", "(i) z", "(ii) z", "(v) u", "(iv) u", "(x) w", "(3)", "(12)", "(2) not marks", "text", "", "  (c) c", " (iii) t"]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lines = df.select("id", F.posexplode(F.split("t", "\n", -1)).alias("n", "line"))
    got: dict = {}
    for r in sorted(P.nested_parts(lines, ["id"], ["n"]).collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.label, r.level, r.marks))
    assert got == {i: p for i, t in enumerate(texts) if (p := _plain_parts(t))}


SCHEME = [
    (1, "Question Answer Mark\nNumber\n1 The correct answer is A (newton)\nB is incorrect because a joule\nis energy\n\nC is not correct because it is\n2\n2 180\nB is the correct answer\nA is incorrect because mass has no direction\n9 The correct answer is D\nTotal for question 9 3"),
    (2, "use of F = ma (1)\nAll the material in it\n14\ncorrect value (1)\nTotal for Question 11 5\n1 The correct answer is C"),
]


def test_answers_of_a_mark_scheme(spark):
    df = _frame(spark, SCHEME)
    got = sorted(P.scheme_answers(df, "doc", "page", "text").collect(), key=lambda r: r.ordinal)
    # 9 has a block of its own, so its row of the table is left out; the second row of 1 is, too
    assert [(r.question_number, r.strategy, r.marks, r.answer, r.distractors, r.page) for r in got] == [
        ("1", "mcq_table", 1, "A", ["B", "C"], 1), ("2", "mcq_table", 1, "B", ["A"], 1), ("9", "terminator", 3, None, [], 1), ("11", "terminator", 5, None, [], 2),
    ]
    assert got[0].text == "1 The correct answer is A (newton)\nB is incorrect because a joule\nis energy\nC is not correct because it is"
    assert got[3].text == "use of F = ma (1)\ncorrect value (1)"
    rep = {r.strategy: (r.answers, r.marks, r.with_answer, r.distractors) for r in P.scheme_report(P.scheme_answers(df, "doc", "page", "text")).collect()}
    assert rep == {"mcq_table": (2, 2, 2, 3), "terminator": (2, 8, 0, 0)}
    assert P.scheme_answers(df.where("false"), "doc", "page", "text").count() == 0


def test_chunks_of_questions_and_answers(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("d", "o", "ab" * 32), ("e", "o", None)], "source_document_id string, offering_id string, sha256 string")
    pages = _frame(spark, PAGES).unionByName(_frame(spark, PAGES, "e"))
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    q = P.question_chunks(P.paper_questions(pages, "doc", "page", "text"), docs, F.lit("ocr_tesseract"), namespace=ns).collect()
    assert {(r.source_document_id, r.question_number, r.provenance_status) for r in q} == {("d", n, "ocr_uncertain") for n in "123"}
    assert all(r.chunk_key == f"inkwell:v1:{'ab' * 32}:q/{r.question_number}" for r in q) and len({r.chunk_id for r in q}) == 3
    a = {r.question_number: r for r in P.answer_chunks(P.scheme_answers(_frame(spark, SCHEME), "doc", "page", "text"), docs, namespace=ns).collect()}
    assert a["1"].notes == "Mark scheme, parsed by the mcq_table strategy. Correct option: A. Explains why B, C are incorrect."
    assert a["2"].notes.endswith("Explains why A is incorrect.") and a["11"].notes == "Mark scheme, parsed by the terminator strategy." and a["11"].text == a["11"].text_raw
