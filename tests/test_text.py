import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators.rechunk import Window, rechunk, windows


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"t {kind}")
    return df.select(fn(F.col("t")).alias("r")).first()["r"]


def test_nfc_strip_and_normalised(spark):
    assert one(spark, "éx", X.nfc) == "éx"
    assert one(spark, "  a b \t\n", X.strip) == "a b"
    assert one(spark, " a  \n b\t\n", X.normalised) == "a\n b"
    assert one(spark, None, X.nfc) is None
    assert one(spark, "   ", X.blank_to_null) is None


def test_uuid5_is_that_of_the_standard_library(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for name in ("", "a", "ক-৯", "x" * 1000):
        assert one(spark, name, lambda c: X.uuid5(ns, c)) == str(uuid.uuid5(uuid.UUID(ns), name))


def test_token_estimate_and_language(spark):
    df = spark.createDataFrame([("", None), ("one two", "en"), ("one two three", "bn"), ("বাংলা লেখা", None), (None, "en"), (" ", "fr")], "t string, l string")
    rows = df.select(X.token_estimate(F.col("t"), F.col("l")).alias("n"), X.script_language(F.col("t"), F.col("l")).alias("g")).collect()
    assert [r.n for r in rows] == [0, 2, 4, 3, None, 1]
    assert [r.g for r in rows] == ["unknown", "en", "bn", "bn", "en", "unknown"]


def test_cleaning_stages(spark):
    rows = [
        (1, "ককোন হললো", "bn"),
        (2, "able to e narrate facts, e take part", "en"),
        (3, "the letter e is", "en"),
        (4, "prac- tise and multi- lingual, multi-racial", "fr"),
        (5, "a  b \n\n\n\nc", None),
        (6, None, "en"),
        (7, "", "bn"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, lang string").withColumn("key", F.lit("clash")).withColumn("kept", F.lit(1))
    got = {r.key: r for r in X.clean(df, "id", "text", "lang").collect()}
    assert got[1].text == "কোন হলো" and got[1].doubled == 2
    assert got[2].text == "able to\n• narrate facts,\n• take part" and got[2].bullets == 2
    assert got[3].bullets == 0
    assert got[4].text == "practise and multi-lingual, multi-racial" and got[4].joined == 2
    assert got[5].text == "a b\n\nc" and got[5].spaces == 2
    assert got[6].text is None and got[6].joined == 0 and got[7].text == ""


def test_references(spark):
    assert one(spark, "see 131 and 952", X.repair_references) == "see 1.3.1 and 952"
    assert one(spark, "2.3.4, 1.1.1 2.3.4", X.references) == ["1.1.1", "2.3.4"]


def test_fingerprint_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    h = [r.h for r in df.select(X.fingerprint(["x", "y"]).alias("h")).collect()]
    assert h[0] == h[2] != h[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc .?\n", max_size=60), max_size=80), st.sampled_from(["en", "bn", None]))
def test_windows_keep_every_word_in_order(parts, lang):
    text = " ".join(parts)
    w = Window(most=40, overlap=6, stub=10)
    pieces = windows(text, lang, w)
    assert [x for p in pieces for x in p.text.split()[p.carried :]] == text.split()
    longest = max((len(x) for x in text.split()), default=0)
    assert all(p.tokens <= w.most or longest > w.most for p in pieces)
    bare = text.strip()
    assert all(bare[p.start : p.end].split() == p.text.split()[p.carried :] for p in pieces)
    assert all(a.end <= b.start for a, b in zip(pieces, pieces[1:]))


def test_windows_edges(spark):
    assert windows(None) == [] and windows(" \n ") == []
    assert windows("short text") == [("short text", 2, 0, 0, 10)]
    long = " ".join(["word"] * 2000)
    # one sentence is cut at 550 words, each next piece takes over 50; the last 350 are no stub
    assert [(p.tokens, p.carried) for p in windows(long)] == [(550, 0), (600, 50), (600, 50), (400, 50)]
    assert [(p.tokens, p.carried) for p in windows(" ".join(["word"] * 1150))] == [(550, 0), (600, 0)]


def test_windows_take_over_whole_sentences_and_even_out_stubs():
    sentence = "One two three four five six seven eight nine ten."
    text = " ".join([sentence] * 62)  # 620 words: the second piece is a stub of 20 and what it takes over
    first, second = windows(text)
    assert (first.tokens, second.tokens, second.carried) == (310, 360, 50) and second.text.startswith("One two")
    assert text[second.start : second.end] == " ".join([sentence] * 31) and first.end < second.start
    three = windows(" ".join([sentence] * 150))
    assert [p.tokens for p in three] == [600, 600, 400] and all(p.carried == 50 for p in three[1:])
    bn = windows("গ্যাসের চাপ বাড়লে আয়তন কমে যায়। " * 120, "bn")
    assert all(p.tokens <= 600 for p in bn) and len(bn) > 2 and all("।" in p.text for p in bn)


def test_windows_of_frames(spark):
    df = spark.createDataFrame([(1, "a b.", "en"), (2, None, "en"), (None, "x", "en"), (1, "a b.", "en")], "k int, t string, l string")
    got = [tuple(r) for r in rechunk(df, "k", "t", "l").collect()]
    assert sorted(got) == [(1, 0, "a b.", 2, 0, 0, 4)] * 2
    assert unicodedata.normalize("NFC", "é") == "é"
