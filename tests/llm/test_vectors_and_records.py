import json
import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import formatdup, neighbours, printform


def _brute(ids, x, k, least=-2.0):
    """id -> the k most similar other ids, ties to the smaller id."""
    x = np.array(x, np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, row in zip(ids, np.round(x @ x.T, 6)):
        out[i] = [j for _, j in sorted((-c, j) for j, c in zip(ids, row) if j != i and c >= least)[:k]]
    return out


def _lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r["rank"])):
        out.setdefault(r.vec_id, []).append(r.other_id)
    return out


def test_nearest_vectors_equal_brute_force_and_leave_out_the_unusable(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    rows = []
    for i, b in enumerate(base):
        rows.append((i, (b / np.linalg.norm(b)).tolist()))
        rows.append((100 + i, (2.5 * (b + 0.1 * rng.standard_normal(16))).tolist()))
    rows += [(200 + i, base[0].tolist()) for i in range(9)]  # equal directions, more than k
    bad = [(900, None), (901, [0.0] * 16), (902, [1.0] * 8), (903, [math.nan] + [1.0] * 15), (904, [math.inf] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, vector array<double>").withColumn("unit", F.lit(1)).withColumn("same", F.lit("x"))
    ids, x = zip(*rows)
    whole, cut = _lists(neighbours.nearest_vectors(df, dims=16, k=3)), _lists(neighbours.nearest_vectors(df, dims=16, k=3, min_cosine=0.8))
    assert whole == _brute(ids, x, 3) and all(len(v) == 3 for v in whole.values())
    assert cut == {i: v for i, v in _brute(ids, x, 3, 0.8).items() if v}
    exact = _lists(neighbours.exact_nearest(df, dims=16, k=3, every=10, at_once=4, sent=8))
    assert exact == {i: v for i, v in whole.items() if i % 10 == 0}
    for least in (None, 0.8):
        assert neighbours.nearest_vectors(df.where("false"), dims=16, min_cosine=least).count() == 0
        assert neighbours.nearest_vectors(df.where("vec_id >= 900"), dims=16, min_cosine=least).count() == 0


def test_every_vector_gets_k_neighbours_whatever_its_distance_and_the_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 128))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got, want = _lists(neighbours.nearest_vectors(df, k=5)), _brute(range(400), x, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.995 * 2000


def test_hot_and_dense_buckets_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    near = [(i, (centre + 0.15 * rng.standard_normal(16)).tolist()) for i in range(700)]
    rest = [(1000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    df = spark.createDataFrame(near + rest, "vec_id long, vector array<double>")
    units = neighbours.usable_vectors(df, "vec_id", "vector", 16)
    want = {i: v for i, v in _brute([i for i, _ in near], [v for _, v in near], 5, 0.8).items()}
    for hot in (100, 10**6):  # buckets above 100 are hot; else they are dense, as nearly all their pairs are near
        got = _lists(neighbours.nearest_vectors(df, dims=16, k=5, min_cosine=0.8, bucket=64, hot=hot).where("vec_id < 1000"))
        assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.97 * 3500
        met = neighbours.similar_pairs(units, 1000, 0.8, 16, k=5, bucket=64, hot=hot).count()
        assert met < 700 * 699 / 4  # far from all pairs of the cluster


def test_code_shape_holds_recall_and_bucket_size_as_it_grows():
    for design in (0.12, neighbours.differing_share(0.8)):
        for n in (0, 1, 10**4, 10**6, 10**8):
            width, pieces = neighbours.code_shape(n, design)
            assert 1 - (1 - (1 - design) ** width) ** pieces >= 0.99 and n <= neighbours.BUCKET * 2**width


def test_probing_finds_what_comparing_all_pairs_finds(monkeypatch):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, (4000, 2), dtype=np.uint64)
    flips = [np.uint64(0)] * 500
    for i in range(500):
        for bit in rng.choice(64, 13, replace=False):
            flips[i] ^= np.uint64(1) << np.uint64(bit)
    codes[1000:1500] = codes[:500] ^ np.stack([np.array(flips), np.array(flips)], axis=1)
    codes[2000] = codes[1]
    probed = neighbours.bucket_pairs(codes, 38, 0.205, 10**6)
    monkeypatch.setattr(neighbours, "SCAN", 10**6)
    whole = neighbours.bucket_pairs(codes, 38, 0.205, 10**6)
    a, b = ({tuple(p) for p in x.tolist()} for x in (probed, whole))
    assert a <= b and len(a) >= 0.98 * len(b) and len(b) >= 501
    assert neighbours.bucket_pairs(codes, 38, 0.205, 100) is None


def test_pairs_near_the_threshold_are_met_among_many(spark, tmp_path):
    """80,000 vectors, so that the buckets and the number of substrings are those of a large table."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((79_100, 128)))
    away = rng.standard_normal((900, 128))
    away = unit(away - (away * base[:900]).sum(1, keepdims=True) * base[:900])
    cos = np.concatenate([np.linspace(0.801, 0.85, 300), np.linspace(0.85, 0.9, 300), np.linspace(0.9, 0.99, 300)])[:, None]
    planted = cos * base[:900] + np.sqrt(1 - cos**2) * away
    x = np.vstack([base, planted]).astype(np.float32)
    vectors = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * 128, x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "vector": vectors}), tmp_path / "vectors.parquet")
    df = spark.read.parquet(str(tmp_path / "vectors.parquet")).repartition(8)
    got = {(r.vec_lo, r.vec_hi) for r in neighbours.neighbour_pairs(df).collect()}
    for ids in (range(300), range(300, 600), range(600, 900)):
        assert np.mean([(i, 79_100 + i) in got for i in ids]) >= 0.95


def _canon(s):
    return "".join(c for c in s.casefold() if not (c.isspace() or unicodedata.category(c)[0] in "PZ"))


def _record_key(content, meta):
    try:
        o = json.loads(meta)
    except (TypeError, ValueError):
        return None
    if not isinstance(o, dict) or not o or content is None or not content.strip():
        return None
    return _canon(content), tuple(sorted((_canon(k), _canon(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))) for k, v in o.items()))


def test_copies_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = ["Ohm's law: V = IR.", "ohms LAW v = ir", "Straße, München", "STRASSE MÜNCHEN", "ক খ। গ", "ক  খ গ", "x² = 2", "x2 = 2", "", "  ", None, "a" * 5000, "A " * 5000]
    metas = ['{"class": "9", "topic": "a b"}', '{"topic": "A-B", "class": " 9"}', '{"class": "9", "topic": "ac"}', "{}", "[1]", "no", None, '{"page": 80}', '{"page": "80"}', '{"k": null}']
    rows = [(i, rnd.choice(texts), rnd.choice(metas), "z") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:3], "record_id long, content string, meta_json string, h1 string")
    got = sorted((r.first_id, r.other_id) for r in formatdup.copy_members(df).collect())
    first, want = {}, []
    for i, c, m, _ in rows:
        k = _record_key(c, m)
        if k is None:
            continue
        if k in first:
            want.append((first[k], i))
        else:
            first[k] = i
    assert got == sorted(want)
    counts = {r.first_id: r.copies for r in formatdup.distinct_records(df).collect()}
    assert set(counts) == set(first.values()) and sum(counts.values()) == len(first) + len(want)
    assert formatdup.copy_members(df.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("aAbB .,'-।কß ", max_size=40), st.text("aAbB .,'-।কß ", max_size=40))
def test_two_pointers_and_hashes_agree_with_canonical_strings(a, b):
    same = _canon(a) == _canon(b)
    assert formatdup.same_but_for_writing(a, b, block=3) == same
    h = formatdup.rolling_hashes([a, b])
    assert (tuple(h[0]) == tuple(h[1])) == same


def test_collision_is_regrouped(spark, monkeypatch):
    def one_print(batches):
        import pyarrow as pa

        for b in batches:
            zero = pa.array([0] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), zero, zero], names=["record_id", "h1", "h2"])

    monkeypatch.setattr(formatdup, "_fingerprints", one_print)
    rows = [(1, "a", '{"k": 1}'), (2, "b", '{"k": 1}'), (3, "A", '{"k": 1}'), (4, "B.", '{"k": 1}')]
    df = spark.createDataFrame(rows, "record_id long, content string, meta_json string")
    assert sorted(map(tuple, formatdup.copy_members(df).collect())) == [(1, 3), (2, 4)]


def test_print_form():
    p = printform.print_form
    assert p("ｔｈｒｅｅ ６１８") == "three 618" and p("café") == "café" and p("chrоma") == "chroma"
    assert p("a​b⁠c﻿") == "abc" and p("a b c") == "a b c" and p("Ω") == "Ω" and p("ﬁsh") == "fish"
    assert p("x²") == "x²" and p("ω") != p("Ω") and p("A") != p("a") and p("a  b") == "a  b" and p("“x”") == "“x”"
    assert p("meas­\nured") != p("meas\nured") and p("me­as") == "meas" and p("done.­\nNext") == "done.\nNext"
    assert p("ক্‍ষ") == "ক্‍ষ" and p("a‍b") == "ab" and p("") == ""
    assert printform.folded_form("ＳＴＲＡẞE") == "strasse"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_print_form_is_its_own_form(s):
    once = printform.print_form(s)
    assert printform.print_form(once) == once


def test_lookalike_pairs(spark):
    rows = [("1", "alpha"), ("2", "аlphа"), ("3", "al​pha"), ("4", "alpha"), ("5", "Alpha"), ("6", None), (None, "alpha"), ("7", ""), ("8", "​"), ("2", "аlphа")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("form", F.lit(1)).withColumn("k", F.lit(2))
    got = sorted(map(tuple, printform.lookalike_pairs(df, "id", "text").collect()))
    assert got == [("1", "2"), ("1", "3"), ("2", "3"), ("2", "4"), ("3", "4"), ("7", "8")]
    assert printform.lookalike_pairs(df.where("false"), "id", "text").count() == 0
    forms = printform.with_print_form(df, "text", "out", fold=True)
    assert {r.out for r in forms.where("id = '5'").collect()} == {"alpha"}


def test_long_texts_are_hashed_slice_by_slice(monkeypatch):
    texts = ["Straße, 12 " * 400, "STRASSE 12" * 400, "a b", "", " .,", "ক খ গ " * 300]
    whole = formatdup.rolling_hashes(texts)
    monkeypatch.setattr(formatdup, "_SLICE_CHARS", 64)
    assert (formatdup.rolling_hashes(texts) == whole).all() and (whole[0] == whole[1]).all() and (whole[3] == 0).all()


def test_print_form_of_signs_and_vowels_of_other_scripts():
    same = [("অা", "আ"), ("अा", "आ"), ("अो", "ओ"), ("क৷", "क।"), ("paӏӏ", "pall"), ("ɡas", "gas"), ("ᎪᏴ", "AB"), ("ꓮꓐ", "AB"), ("एे", "ऐ")]
    assert all(printform.print_form(a) == printform.print_form(b) for a, b in same)
    assert printform.print_form("अब") != printform.print_form("आब") and printform.print_form("") == ""


def test_classes_hold_the_rows_of_the_pairs(spark):
    rows = [("a", "gas"), ("b", "g\u0430s"), ("c", "gas"), ("c", "gas"), ("d", "gаs "), ("e", "other"), ("f", None), (None, "gas")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("form", F.lit(1)).withColumn("k", F.lit(2))
    pairs = {(r.first_key, r.second_key) for r in printform.lookalike_pairs(df, "id", "text").collect()}
    assert pairs == {("a", "b"), ("b", "c")}
    classes = printform.lookalike_classes(df, "id", "text").collect()
    assert {r.key for r in classes} == {"a", "b", "c"} and all(r.spellings == 2 and r.members == 3 for r in classes)
    assert printform.lookalike_classes(df.where("false"), "id", "text").count() == 0
