"""Duplicates hidden by formatting differences (problem 4).

A record's fingerprint is made from rolling polynomial hashes over the code points of its
content and of every metadata field. A lookup table folds a code point's case or skips it
(white space, punctuation), so no canonical string is ever built; field hashes are added up,
so the order of the fields has no effect. Rows with equal 128-bit fingerprints are then held
against the first row of their group by a two-pointer comparison that skips the same characters.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.session import staged

_TABLE_SIZE = 0x20000
_SLICE_CHARS = 1 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STATE: dict = {}


def _fold_code(cp: int) -> int:
    """The folded code point, or 0 for a character that is skipped."""
    ch = chr(cp)
    if ch.isspace() or unicodedata.category(ch)[0] in "PZ" or 0xD800 <= cp < 0xE000:
        return 0
    folded = ch.casefold()
    return ord(folded) if len(folded) == 1 else cp


def _skip_and_fold() -> np.ndarray:
    if "table" not in _STATE:
        _STATE["table"] = np.array([_fold_code(c) for c in range(_TABLE_SIZE)], np.uint32)
        # the few letters whose full case folding is longer than one character (ß, ligatures)
        _STATE["long"] = {c: chr(c).casefold() for c in range(_TABLE_SIZE) if len(chr(c).casefold()) > 1}
    return _STATE["table"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(joined: str) -> np.ndarray:
    table = _skip_and_fold()
    if not joined.isascii():
        joined = joined.translate(_STATE["long"]) if any(chr(c) in joined for c in _STATE["long"]) else joined
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < _TABLE_SIZE, table[np.minimum(raw, _TABLE_SIZE - 1)], raw)


def rolling_hashes(texts: list[str]) -> np.ndarray:
    """Two rolling polynomial hashes (rows x 2, uint64) of each text, skipping and folding as it goes."""
    _skip_and_fold()
    long = _STATE["long"]
    out = np.zeros((len(texts), 2), np.uint64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > _SLICE_CHARS:
            out[at] = _long_hashes(texts[at])
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _SLICE_CHARS):
            size += len(texts[end])
            end += 1
        part = [t if t.isascii() else t.translate(long) for t in texts[at:end]]
        lens = np.fromiter(map(len, part), np.int64, len(part))
        raw = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(raw < _TABLE_SIZE, _STATE["table"][np.minimum(raw, _TABLE_SIZE - 1)], raw)
        kept = codes != 0
        row = np.repeat(np.arange(len(part)), lens)[kept]
        value = _mix(codes[kept].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        count = np.bincount(row, minlength=len(part))
        start = np.cumsum(count) - count
        place = np.arange(len(value)) - start[row]
        some = count > 0
        if some.any():
            top = int(count.max())
            for k, base in enumerate(_BASES):
                powers = np.cumprod(np.full(top, base, np.uint64))
                sums = np.add.reduceat(value * powers[place], start[some])
                out[at:end, k][some] = _mix(sums + count[some].astype(np.uint64))
        at = end
    return out


def _long_hashes(text: str) -> np.ndarray:
    """The hashes of one long text, read slice by slice: a slice's sum is moved on by the power of the characters kept before it."""
    sums, kept, word = [0, 0], 0, 1 << 64
    for lo in range(0, len(text), _SLICE_CHARS):
        codes = _codes(text[lo : lo + _SLICE_CHARS])
        value = _mix(codes[codes != 0].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k, base in enumerate(_BASES):
            own = int((value * np.cumprod(np.full(len(value), base, np.uint64))).sum(dtype=np.uint64))
            sums[k] = (sums[k] + own * pow(int(base), kept, word)) % word
        kept += len(value)
    return _mix(np.array(sums, np.uint64) + np.uint64(kept)) if kept else np.zeros(2, np.uint64)


def _fields(meta: str | None) -> dict | None:
    """The metadata object, or None where it isn't a non-empty JSON object."""
    try:
        got = json.loads(meta) if meta is not None else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) and got else None


def _as_text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _blank(content: str | None) -> bool:
    return content is None or not any(not (c.isspace() or unicodedata.category(c) == "Cf") for c in content)


def _fingerprint_batch(ids: pa.Array, contents: list, metas: list) -> pa.RecordBatch:
    keep, texts, owner = [], [], []
    for i, (content, meta) in enumerate(zip(contents, metas)):
        if _blank(content) or (fields := _fields(meta)) is None:
            continue
        k = len(keep)
        keep.append(i)
        texts.append(content)
        owner.append((k, 0))
        for name, value in fields.items():
            texts += [name, _as_text(value)]
            owner += [(k, 1), (k, 2)]
    h = rolling_hashes(texts)
    who = np.array([o[0] for o in owner], np.int64)
    what = np.array([o[1] for o in owner], np.int64)
    total = np.zeros((len(keep), 2), np.uint64)
    total[who[what == 0]] = _mix(h[what == 0])
    field = _mix(h[what == 1] * np.uint64(3) + _mix(h[what == 2] + np.uint64(1)))
    np.add.at(total, who[what == 1], field)
    total = total.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(keep, pa.int64())), pa.array(total[:, 0], pa.int64()), pa.array(total[:, 1], pa.int64())],
        names=["record_id", "h1", "h2"],
    )


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _fingerprint_batch(b.column(0).cast(pa.int64()), b.column(1).to_pylist(), b.column(2).to_pylist())


def same_but_for_writing(a: str, b: str, block: int = 4096) -> bool:
    """Two-pointer comparison of two texts that skips white space and punctuation and ignores case.

    Both texts are read in blocks; only the folded codes not yet matched are held.
    """
    if a == b:
        return True
    i = j = 0
    left, right = np.empty(0, np.uint32), np.empty(0, np.uint32)
    while True:
        while not len(left) and i < len(a):
            part = _codes(a[i : i + block])
            left, i = part[part != 0], i + block
        while not len(right) and j < len(b):
            part = _codes(b[j : j + block])
            right, j = part[part != 0], j + block
        n = min(len(left), len(right))
        if not n:
            return len(left) == len(right)
        if not np.array_equal(left[:n], right[:n]):
            return False
        left, right = left[n:], right[n:]


def _same_record(c1: str, m1: str, c2: str, m2: str) -> bool:
    if not same_but_for_writing(c1, c2):
        return False
    if m1 == m2:
        return True
    f1, f2 = _fields(m1), _fields(m2)
    if f1 is None or f2 is None or len(f1) != len(f2):
        return False
    if f1.keys() == f2.keys():
        return all(same_but_for_writing(_as_text(v), _as_text(f2[k])) for k, v in f1.items())
    left = sorted(f1.items(), key=lambda kv: _codes(kv[0])[_codes(kv[0]) != 0].tobytes())
    right = sorted(f2.items(), key=lambda kv: _codes(kv[0])[_codes(kv[0]) != 0].tobytes())
    return all(same_but_for_writing(k, q) and same_but_for_writing(_as_text(v), _as_text(w)) for (k, v), (q, w) in zip(left, right))


@F.arrow_udf(T.BooleanType())
def _same_udf(c1: pa.Array, m1: pa.Array, c2: pa.Array, m2: pa.Array) -> pa.Array:
    return pa.array([_same_record(*row) for row in zip(*(x.to_pylist() for x in (c1, m1, c2, m2)))], pa.bool_())


@F.arrow_udf(T.StringType())
def _exact_udf(c: pa.Array, m: pa.Array) -> pa.Array:
    """The materialised canonical record; only for rows whose fingerprint collided."""
    out = []
    for content, meta in zip(c.to_pylist(), m.to_pylist()):
        parts = [content, *sorted(f"{k}\x01{_as_text(v)}" for k, v in _fields(meta).items())]
        out.append("\x02".join(_codes(p)[_codes(p) != 0].astype("<u4").tobytes().hex() for p in parts))
    return pa.array(out, pa.string())


def _input(df: DataFrame, record_id: str, content: str, meta: str) -> DataFrame:
    return df.select(
        F.col(f"`{record_id}`").cast("long").alias("record_id"),
        F.col(f"`{content}`").cast("string").alias("content"),
        F.col(f"`{meta}`").cast("string").alias("meta"),
    ).where("record_id is not null")


def copy_members(df: DataFrame, record_id: str = "record_id", content: str = "content", meta: str = "meta_json") -> DataFrame:
    """first_id, other_id for every record that repeats another apart from its writing.

    first_id is the smallest id of the set. Rows with a null id, null or blank content, or metadata that
    isn't a non-empty JSON object take no part; a repeated row (same id) counts once; an empty table gives
    no rows; other columns are ignored. Fingerprints are pre-aggregated before the shuffle, and each
    member is compared with its set's first row only, so a set holding a third of all rows makes as many
    comparisons as it has members.
    """
    rows = _input(df, record_id, content, meta)
    return _members(rows, fingerprints(rows))


def fingerprints(rows: DataFrame) -> DataFrame:
    """record_id, h1, h2 of the rows that take part, written once."""
    return staged(rows.mapInArrow(_fingerprints, "record_id long, h1 long, h2 long"), "fingerprints")


def _members(rows: DataFrame, prints: DataFrame) -> DataFrame:
    sets = prints.groupBy("h1", "h2").agg(F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
    several = sets.where("first_id < last_id").select("h1", "h2", "first_id")
    members = prints.join(several, ["h1", "h2"]).where("record_id > first_id").select("record_id", "first_id").distinct()
    firsts = rows.select(F.col("record_id").alias("first_id"), F.col("content").alias("c1"), F.col("meta").alias("m1"))
    firsts = firsts.join(several.select("first_id").distinct(), "first_id", "left_semi").dropDuplicates(["first_id"])
    both = members.join(rows, "record_id").dropDuplicates(["record_id"]).join(firsts, "first_id")
    same = _same_udf("c1", "m1", "content", "meta").alias("same")
    judged = staged(both.select("first_id", "record_id", same), "copies")
    good = judged.where("same").select("first_id", F.col("record_id").alias("other_id"))
    collided = judged.where("not same").select("first_id", "record_id")
    if collided.isEmpty():
        return good
    # rows whose fingerprint is that of a different record are grouped by their exact canonical form
    exact = collided.join(rows, "record_id").dropDuplicates(["record_id"])
    exact = exact.select("first_id", "record_id", F.sha2(_exact_udf("content", "meta"), 256).alias("exact"))
    again = exact.groupBy("first_id", "exact").agg(F.min("record_id").alias("own_first"))
    late = exact.join(again, ["first_id", "exact"]).where("record_id > own_first")
    return good.unionByName(late.select(F.col("own_first").alias("first_id"), F.col("record_id").alias("other_id")))


def distinct_records(df: DataFrame, record_id: str = "record_id", content: str = "content", meta: str = "meta_json") -> DataFrame:
    """One row per record after copies are collapsed: first_id and the number of copies it stands for (itself included).

    Takes and leaves out the same rows as copy_members.
    """
    rows = _input(df, record_id, content, meta)
    prints = fingerprints(rows)
    taking_part, pairs = prints.select("record_id").distinct(), _members(rows, prints)
    counts = pairs.groupBy("first_id").agg(F.count("*").alias("others"))
    kept = taking_part.join(pairs, taking_part.record_id == pairs.other_id, "left_anti")
    return kept.join(counts, kept.record_id == counts.first_id, "left").select(
        F.col("record_id").alias("first_id"), (F.coalesce("others", F.lit(0)) + 1).alias("copies")
    )
