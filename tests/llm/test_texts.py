import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import junk, language, scans

EN = "The pressure of the gas rises when the volume falls. Many answers named the unit correctly but did not explain it."
FR = "La pression du gaz augmente quand le volume diminue. Les élèves confondent souvent la vitesse et la force pendant l'évaluation."
ES = "La presión del gas aumenta cuando el volumen disminuye. Los alumnos confunden a menudo la velocidad con la fuerza en clase."
BN = "গ্যাসের চাপ বাড়লে আয়তন কমে যায়। শিক্ষার্থীরা প্রায়ই বেগ এবং বলের মধ্যে পার্থক্য করতে ভুল করে।"
HI = "गैस का दाब बढ़ने पर आयतन घट जाता है। विद्यार्थी अक्सर वेग तथा बल में अंतर नहीं कर पाते।"
ALL = {"en": EN, "fr": FR, "es": ES, "bn": BN, "hi": HI}


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(2)
    rows = []
    for lang, text in ALL.items():
        for _ in range(40):
            parts = text.replace("।", "।|").replace(".", ".|").split("|")
            label = rnd.choice(list(ALL)) if rnd.random() < 0.15 else lang
            rows.append((" ".join(rnd.sample(parts, len(parts))), label))
    df = spark.createDataFrame(rows + [(None, "en"), ("x", None)], "text string, lang string")
    return language.fit(df, "text", "lang", sample_rows=100)


def test_languages_segments_and_nothing(spark, model):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(ALL.items())]
    rows += [(10, EN + " " + FR, " EN-gb "), (11, BN + "\n\n" + HI, "hi"), (12, "12 A\n13 B\nx² = 5 kg", "en"), (13, None, "en"), (14, "", None), (15, EN + " " + EN + " কণা", "unknown")]
    rows += [(16, "গ্যাসের চাপ বাড়লে pressure কমে যায়।", "bn"), (17, "<a href=\"http://a.b/pressure\">La pression</a> " + EN, "en"), (18, "pressurized gases", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row_key", F.lit("clash"))
    got = {int(r.row_key): r for r in language.label_texts(df, "doc_id", "text", "lang", model).collect()}
    assert [got[i].main for i in range(5)] == list(ALL)
    assert all(got[i].confidence > 0.9 and got[i].whole == [lang] for i, lang in enumerate(ALL))
    assert got[10].whole == ["en", "fr"] and [p.lang for p in got[10].passages] == ["en", "fr"] and got[11].whole == ["bn", "hi"]
    assert got[12].main is None and got[13].main is None and got[14].main is None
    assert got[15].main == "en" and got[15].whole == ["en"] and got[16].whole == ["bn"] and got[17].whole == ["en"] and got[18].main == "en"
    lab = language.label_texts(df, "doc_id", "text", "lang", model)
    wrong = {int(r.row_key): r.lang for r in language.wrong_labels(lab).collect()}
    assert wrong == {15: "en", 18: "en"} | ({11: got[11].main} if got[11].main != "hi" else {}) | ({10: got[10].main} if got[10].main != "en" else {})
    p = got[10].passages[1]
    assert language.clean(EN + " " + FR)[p.start : p.end].startswith("La pression")


def test_language_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = language.fit(df, "text", "lang")
    assert language.label_texts(df, "doc_id", "text", "lang", m).count() == 0
    one = spark.createDataFrame([(1, EN, "en")], "doc_id long, text string, lang string")
    assert language.label_texts(one, "doc_id", "text", "lang", m).count() == 1


def test_owner_languages(spark, model):
    rows = [("a", EN, "d1"), ("b", EN, "d1"), ("c", FR, "d1"), ("d", BN, "d2"), ("e", None, "d3"), ("f", HI, None)]
    lab = language.label_texts(spark.createDataFrame(rows, "id string, text string, o string").withColumn("l", F.lit("en")), "id", "text", "l", model, "o")
    assert {r.owner: r.main for r in language.owner_languages(lab).collect()} == {"d1": "en", "d2": "bn"}


def _page(head, body, foot):
    return "\n".join([head, *body, foot])


def test_scanned_pages(spark):
    vocab = "the pressure of the gas rises when the volume falls and the well-known law holds for every simple experiment in this long chapter"
    ref = spark.createDataFrame([(vocab,)] * 3, "text string")
    heads = ["Simple Gases 4", "Sirnple Gases 4", "SIMPLE GASES 4", "Simple  Gases  4"]
    rows = []
    for i in range(8):
        body = ["the pressure of the gas rises when the vol-", "ume falls and the well-", "known law holds for evcry simple"] if i == 0 else ["the gas and the " + "law holds every simple experiment long chapter".split()[i - 1] + " rises when the volume falls"]
        rows.append(("ocr_pages", str(i), "d", i + 1, _page(heads[i % 4], body, f"— {i + 1} —")))
    rows.append(("chunks", "x", "d", 3, "LEAVE\nTHIS\nMARGIN\nBLANK\nthe gas rises.\n........\n*X00000A0000*\n(3)\n[12]\n\nknalb nigram siht evael\nL e a v e t h i s m a r g i n b l a n k"))
    rows += [("chunks", f"x{k}", "d", 3, "LEAVE\nTHIS\nMARGIN\nBLANK\nthe law holds.\nLeave this margin blank ......") for k in range(3)]
    rows += [("chunks", "n", "d", 1, None), ("chunks", "e", None, None, ""), ("chunks", "s", "d", 1, "the exper- iment and short- and long"), ("chunks", "d1", "d", 1, "we held 5l0 and 5O and 510 there")]
    df = spark.createDataFrame(rows + rows[:2], "tbl string, row_key string, doc string, page int, text string").withColumn("skeleton", F.lit("clash"))
    f = scans.find(df, ref, "text")
    marks = {}
    for r in scans.marked_lines(f).collect():
        marks.setdefault((r.tbl, r.row_key), set()).add((r.line_no, r.kind))
    assert marks["ocr_pages", "0"] == {(1, "furniture"), (2, "hyphen"), (4, "misread"), (5, "furniture")}
    assert all(marks["ocr_pages", str(i)] == {(1, "furniture"), (3, "furniture")} for i in range(1, 8))
    assert {n for n, k in marks["chunks", "x"] if k == "furniture"} == {1, 2, 3, 4, 6, 7, 9, 11, 12}
    assert {n for n, k in marks["chunks", "x1"]} == {1, 2, 3, 4, 6}
    assert marks["chunks", "s"] == {(1, "hyphen")} and marks["chunks", "d1"] == {(1, "misread")}
    fixed = {(r.tbl, r.row_key): r.text for r in scans.repaired(df, f).collect()}
    assert fixed["ocr_pages", "0"] == "the pressure of the gas rises when the volume falls and the well-known law holds for every simple"
    assert fixed["chunks", "n"] is None and fixed["chunks", "e"] == "" and fixed["chunks", "s"] == "the experiment and short- and long"
    empty = scans.find(df.where("false"), ref.where("false"), "text")
    assert scans.marked_lines(empty).count() == 0


def test_set_off_lines_and_numbers_are_furniture_only_where_they_come_back(spark):
    body = "The pressure of the gas rises when the volume falls.\nMany answers named the unit correctly."
    lone = "Compare the two forces.\nNEWTON'S LAWS OF MOTION\nChapter 3\nQuestion 7\nWhat is the sum?\n42"
    rows = [("chunks", "c1", "d9", None, lone), ("chunks", "c2", "d9", None, "42"), ("chunks", "c3", "d1", None, f"{body}\nFIRST STEPS IN GASES 2\n{body}")]
    rows += [("ocr_pages", f"o{k}", "d2", k, f"{k + 8}\n{body}") for k in (37, 38, 39)]  # printed numbers run eight ahead of the pages
    rows += [("ocr_pages", "o45", "d3", 45, f"37\n{body}"), ("ocr_pages", "o46", "d3", 46, f"46\n{body}")]
    rows += [("ocr_pages", f"h{k}", "d4", k, f"KINETIC ENERGY   {k}\n{body}") for k in (3, 5, 7)]
    df = spark.createDataFrame(rows, "tbl string, row_key string, doc string, page int, text string")
    docs = spark.createDataFrame([("d1", "First Steps in Gases 2"), (None, "x"), ("d5", None)], "id string, title string")
    ref = spark.createDataFrame([(body,), (body,)], "text string")
    f = scans.find(df, ref, "text", scans.title_skeletons(docs, "id", "title"))
    got = {(r.row_key, r.line_no) for r in f.furniture.collect()}
    assert got == {("c3", 3), ("o37", 1), ("o38", 1), ("o39", 1), ("o46", 1), ("h3", 1), ("h5", 1), ("h7", 1)}
    without = {(r.row_key, r.line_no) for r in scans.find(df, ref, "text").furniture.collect()}
    assert without == got - {("c3", 3)}


def test_words_broken_over_pages_and_long_gaps_are_found(spark):
    words = "the pressure of the gas rises when its volume falls and a gauge"
    rows = [("ocr_pages", "a", "d", 1, "the gas rises when the vol-\n— 1 —"), ("ocr_pages", "b", "d", 2, "— 2 —\nume falls."), ("ocr_pages", "c", "e", 2, "ume falls and the pres-")]
    rows += [("ocr_pages", "g", "f", 1, "the gas and its pres-\n" + "........\n" * 20 + "sure rises")]
    df = spark.createDataFrame(rows, "tbl string, row_key string, doc string, page int, text string")
    f = scans.find(df, spark.createDataFrame([(words,)] * 3, "text string"), "text")
    got = {(r.row_key, r.line_no, r.next_key, r.next_line, r.joined) for r in f.hyphens.collect()}
    assert got == {("a", 1, "b", 2, "volume"), ("g", 1, "g", 22, "pressure")}
    assert not f.misread.count()
    text = {r.row_key: r.text for r in scans.repaired(df, f).collect()}
    assert text["a"] == "the gas rises when the vol-" and text["b"] == "ume falls." and text["g"] == "the gas and its pressure rises"


def test_corrections_stay_on_their_line():
    text = "The tlie sum is known.\n\nA tlie of silk."
    assert scans._rebuild(text, set(), [], {1: [("tlie", "the")]}) == "The the sum is known.\n\nA tlie of silk."


def test_common_words_are_cut_by_their_counts(spark):
    words = spark.createDataFrame([(f"w{i}", i) for i in range(1, 1001)], "word string, n long")
    for most in (1, 50, 400, 5000):
        got = {r.n for r in scans.most_frequent(words, most).collect()}
        assert got == set(range(min(got), 1001)) and (len(got) <= max(most, 200))


def test_junk_pages(spark):
    lines = "\n".join(f"http://shop{i}.test/p/{i}" for i in range(20))
    stuffed = " ".join(w for i, x in enumerate(EN.split()) for w in ([x, "cheap gas course"] if i % 2 else [x]))
    pages = {
        1: EN,
        2: lines,
        3: EN.split(".")[0] + ".\n\n" + ", ".join(f"{a} gas {b}" for a in ("cheap", "best", "buy", "top") for b in ("notes", "course", "book")),
        4: "\n".join(f"gas {n} SKU-{1000 + i} €{i + 9} ★{i % 5}" for i, n in enumerate(["notes", "book"] * 8)),
        5: " ".join(f"#gas{i % 3} #volume" for i in range(20)),
        6: stuffed,
        7: "\n".join(f"{i}. 1.{i} Pressure ........ {3 * i}" for i in range(1, 15)),
        8: "\n".join(f"{i} {'ABCD'[i % 4]}" for i in range(1, 30)),
        9: "Gases\n" + "\n".join(f"pressure\t{i}.5\t{i}.25" for i in range(12)),
        10: "\n".join(f"gas: https://read{i}.test/r/{i}. The pressure of the gas rises when the volume falls in every case." for i in range(6)),
        11: "23 Which is it?\nA pressure\nB volume\nC force\nD speed\n(Total for Question 23 = 1 mark)",
        12: "cheap gas notes\nbook 4\nbest gas course\nbuy gas notes\nnotes 7\ntop volume notes\ncourse 3\nbest volume book\nbook 9\nbuy gas book",
        13: "",
        14: None,
        15: "   \n ",
        16: EN * 2000,
    }
    df = spark.createDataFrame(list(pages.items()), "doc_id long, text string").withColumn("kind", F.lit("clash"))
    assert {r.doc_id for r in junk.junk_pages(df.unionByName(df)).collect()} == {2, 3, 4, 5, 6, 12}
    assert {r.doc_id for r in junk.judged_pages(df).collect()} == set(pages) - {13, 14, 15}
    assert junk.junk_pages(df.where("false")).count() == 0
    judged = {r.doc_id: r for r in junk.judged_pages(df).collect()}
    assert all(r.is_junk == (r.few_share >= 0.5) for r in judged.values()) and judged[4].top_kind == "products"
    groups = junk.junk_groups(df).collect()
    assert sum(r.junk for r in groups) == 6 and {r.kind for r in groups} >= {"links", "tags", "products"}


def test_a_page_of_many_different_junk_shapes_is_not_dominated_by_few(spark):
    mixed = [("gas " * k).strip() + " http://shop.test/" + "p" * k for k in (1, 9, 15, 30)]
    mixed += ["; ".join(["gas notes book course"] * k) for k in (4, 7, 15, 27)] + [" ".join(["#gas"] * k) for k in (1, 2, 9, 14, 30)]
    row = junk.judged_pages(spark.createDataFrame([(1, "\n".join(mixed))], "doc_id long, text string"), few=2).first()
    assert row.junk_share > 0.9 and row.few_share < row.junk_share


@pytest.mark.parametrize(
    "line, kind",
    [
        ("See http://a.test/x for the answers", "links"),
        ("gas: https://a.test/r. The pressure of the gas rises when the volume falls.", "remark"),
        ("#gas #pressure book", "tags"),
        ("gas notes SKU-4725 $520 top", "products"),
        ("1.2 Pressure ........ 14", "contents"),
        ("pressure\t1.5\t2", "columns"),
        ("12 A", "number"),
        ("worksheet 9", "label"),
        ("The pressure rises.", "text"),
        ("a gas, b gas, c gas, d gas, e gas, a gas", "keywords"),
    ],
)
def test_shapes_tell_what_a_line_holds(line, kind):
    assert junk.line_shape(line)[0].kind == kind


def test_notices_and_torn_lines_are_no_sentence(spark, model):
    torn = "Les élèves confondent souvent la vitesse\nand zqwx leavv thys margyn\nblank ......\net la force pendant l'évaluation. " + FR
    got = language.label_texts(spark.createDataFrame([(1, torn, "fr"), (2, "zqwx blarg thys margyn only. " + FR, "fr")], "k int, t string, l string"), "k", "t", "l", model).collect()
    assert all(r.whole == ["fr"] and r.main == "fr" for r in got)


def test_forgotten_words_keep_their_own_scores():
    """With room for few unseen words, a word scores as it would alone, whatever was read before."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(6)) for _ in range(400)]
    seen = ["the", "pressure", "gas", "la", "pression", "gaz", "presion", "leave", "under"]
    counts = np.array([[9, 0, 0, 0, 0], [5, 0, 0, 0, 0], [4, 0, 0, 0, 0], [0, 0, 9, 9, 0], [0, 0, 5, 0, 0], [0, 0, 4, 0, 0], [0, 0, 0, 5, 0], [3, 0, 0, 0, 0], [3, 0, 0, 0, 0]], float)
    small = language.WordModel(seen, counts, remember=10)
    for k in range(0, 400, 7):
        batch = words[k : k + 7] + ["the", "theth", "undle"]
        alone = language.WordModel(seen, counts)
        assert np.allclose(small.scores(small.ids(batch)), alone.scores(alone.ids(batch)))
        assert (small.known(small.ids(batch)) == alone.known(alone.ids(batch))).all() and small.filled - len(seen) <= 30


def test_the_sample_is_bounded_and_copies_count_once(spark):
    rows = [(f"{EN} {i}", "en") for i in range(300)] + [(FR, " FR-ca ")] * 5000 + [(ES, "es"), (None, "es"), ("", "en"), ("x", None)]
    df = spark.createDataFrame(rows, "t string, l string").repartition(5)
    model = language.fit(df, "t", "l", sample_rows=20, refits=0)
    assert {"pression", "presión", "pressure"} <= set(model.index)
    assert max(np.exp(model.rows[model.index["pression"]])) < 1  # one copy, not thousands, stands beside the others
    one = language.fit(df.repartition(2), "t", "l", sample_rows=20, refits=0)
    assert set(one.index) == set(model.index)


def test_passages_and_labels_of_every_text(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([EN, FR, EN + " " + FR, "", None, "12 = 3"])], "doc_id long, text string, lang string")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, f"{t} {i}", x) for i in range(20) for t, x in ((EN, "en"), (FR, "fr"), (ES, "es"), (BN, "bn"), (HI, "hi"))], docs.schema))
    chunks = spark.createDataFrame([("c", BN, None, "s1"), ("c", BN, None, "s1"), ("d", FR, "fr", "s1")], "chunk_id string, text string, language string, source_document_id string")
    sources = spark.createDataFrame([("s1", "en"), ("s2", None)], "source_document_id string, declared_language string")
    labels = {(r.tbl, r.row_key): r for r in language.all_labels(docs, chunks, sources).collect()}
    assert labels["documents", "1"].main == "fr" and labels["documents", "1"].confidence > 0.9 and labels["documents", "3"].main is None
    assert labels["chunks", "c"].main == "bn" and labels["source_documents", "s2"].main is None
    parts = sorted((r.place, r.lang, r.start, r.end, r.confidence) for r in language.all_passages(docs, chunks).where("tbl = 'documents' and row_key = '2'").collect())
    assert [(p, x) for p, x, *_ in parts] == [(0, "en"), (1, "fr")] and parts[0][2] == 0 and parts[1][3] == len(EN) + 1 + len(FR) and all(p[4] > 0.9 for p in parts)
