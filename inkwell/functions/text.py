"""Text functions as Column expressions; Arrow functions only where no built-in expresses the rule."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BENGALI = "[\\u0980-\\u09FF]"
# The Bengali consonants and the vowel signs with a part drawn before the consonant, a bullet read as an e, a word
# broken by a hyphen and blanks, a word written with a hyphen, a section reference without and with its dots.
DOUBLED_CONSONANTS = "\\u0995-\\u09B9\\u09CE\\u09A1\\u09BC\\u09A2\\u09AF"
PRE_BASE_SIGNS = "\\u09CB\\u09C7\\u09CC"
LONE_E = "(?<=[a-z,;:]) e (?=[a-z])"
BROKEN_WORD = "\\b([A-Za-z]{2,})-\\s+([A-Za-z]{2,})\\b"
COMPOUND = "\\b([A-Za-z]{2,})-([A-Za-z]{2,})\\b"
LOST_DOTS = "\\b([1-8])(\\d)(\\d)\\b"
REFERENCE = "\\b([1-8]\\.\\d{1,2}\\.\\d{1,2})\\b"


def strip(c: Column) -> Column:
    """Remove all Unicode white space from both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank, stripped."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


@F.arrow_udf(T.StringType())
def _nfc(values: pa.Array) -> pa.Array:
    d = values.dictionary_encode()
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def nfc(c: Column) -> Column:
    """Composed canonical form; text in Latin-1 range is its own form and stays in the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike("[^\\x00-\\xFF]"), c)), c)


def normalised(c: Column) -> Column:
    """NFC, line ends trimmed, outer white space removed."""
    return strip(F.regexp_replace(nfc(c), "(?U)[^\\S\\n]+(?=\\n|$)", ""))


SPACE = "\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"  # what splits words, in a character class


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def bengali_share(c: Column) -> Column:
    """Bengali code points over all; null for null, 0 for the empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(BENGALI)) / F.length(c)).when(c == "", 0.0)


def token_estimate(c: Column, language: Column) -> Column:
    """White-space words, or a third of the characters where the text is Bengali by script or label; at least 1 unless empty, null for null."""
    by_length = F.greatest(F.lit(1), F.floor(F.length(c) / 3).cast("int"))
    by_words = F.greatest(F.lit(1), word_count(c))
    return F.when(c.isNull(), None).when(c == "", 0).when((bengali_share(c) > 0.3) | F.coalesce(language == "bn", F.lit(False)), by_length).otherwise(by_words)


def script_language(c: Column, declared: Column) -> Column:
    """bn where any Bengali character stands, else a declared bn or en, else en for text with content, else unknown."""
    return F.when(c.rlike(BENGALI), "bn").when(declared.isin("bn", "en"), declared).when(strip(c) != "", "en").otherwise("unknown")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (SHA-1) of a string under a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fingerprint(columns: Iterable[str]) -> Column:
    """SHA-256 over the named columns as JSON in the given order; nulls are kept apart from empty strings."""
    fields = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return F.sha2(F.encode(F.to_json(fields, {"ignoreNullFields": "false"}), "utf-8"), 256)


# -- cleaning stages: each returns (repaired text, number of repairs) --


def undouble_consonants(c: Column) -> tuple[Column, Column]:
    pattern = f"([{DOUBLED_CONSONANTS}])\\1([{PRE_BASE_SIGNS}])"
    return F.regexp_replace(c, pattern, "$1$2"), F.regexp_count(c, F.lit(pattern))


def restore_bullets(c: Column, least: int = 2) -> tuple[Column, Column]:
    n = F.regexp_count(c, F.lit(LONE_E))
    return F.when(n >= least, F.regexp_replace(c, LONE_E, "\n• ")).otherwise(c), F.when(n >= least, n).otherwise(0)


def tidy_space(c: Column) -> tuple[Column, Column]:
    """Runs of blanks become one, line ends are trimmed, three or more newlines become two; counts the lines changed."""
    lines = F.split(c, "\n", -1)
    one = lambda x: F.regexp_replace(F.regexp_replace(x, "[ \\t]{2,}", " "), "[ \\t\\r]+$", "")
    changed = F.size(F.filter(lines, lambda x: x != one(x)))
    joined = F.array_join(F.transform(lines, one), "\n")
    squeezed = F.regexp_replace(joined, "\\n{3,}", "\n\n")
    return strip(squeezed), changed + F.when(squeezed != joined, 1).otherwise(0)


def split_words(c: Column) -> Column:
    """The `word- word` breaks of a text as array of [head, tail]."""
    whole = F.regexp_extract_all(c, F.lit(BROKEN_WORD), F.lit(0))
    return F.transform(whole, lambda m: F.split(m, "-\\s+"))


def compound_prefixes(df: DataFrame, text: str) -> DataFrame:
    """prefix: the lower-case first parts of words the corpus writes with a hyphen and no blank; they keep their hyphen."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(COMPOUND), F.lit(1))
    return df.select(F.explode(found).alias("p")).select(F.lower("p").alias("prefix")).distinct()


def join_split_words(df: DataFrame, key: str, text: str, prefixes: DataFrame) -> DataFrame:
    """key, text, joined: `word- word` breaks joined, keeping the hyphen behind a prefix the corpus hyphenates.

    Only the breaks met are looked up, by a join on the prefix, so the set of prefixes may be of any size.
    Rows with a null key are left out; a null text stays null with 0 joins.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null")
    heads = rows.select("key", F.explode(split_words(F.col("text"))).alias("m")).select("key", F.lower(F.col("m")[0]).alias("prefix")).distinct()
    kept = heads.join(prefixes, "prefix", "left_semi").groupBy("key").agg(F.collect_set("prefix").alias("kept"))
    both = rows.join(kept, "key", "left")

    def run(batches):
        pattern = re.compile(BROKEN_WORD)
        for b in batches:
            texts, counts = [], []
            for t, k in zip(b.column("text").to_pylist(), b.column("kept").to_pylist()):
                if t is None:
                    texts.append(None)
                    counts.append(0)
                    continue
                keep = set(k or ())
                new, n = pattern.subn(lambda m, keep=keep: f"{m[1]}{'-' if m[1].lower() in keep else ''}{m[2]}", t)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["key", "text", "joined"])

    schema = both.select("key", "text", F.lit(0).cast("int").alias("joined")).schema
    return both.select("key", "text", "kept").mapInArrow(run, schema)


def clean(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key, text, and the repairs of each stage: doubled, bullets, joined, spaces.

    The stages run in a fixed order on the NFC form; doubling is repaired in bn texts and bullets in en texts only,
    the other stages in all. Rows with a null key are left out; null texts stay null with 0 repairs.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("raw"), F.col(f"`{language}`").alias("lang")).where("key is not null")
    prefixes = compound_prefixes(rows, "raw")
    base = rows.select("key", "lang", nfc(F.col("raw")).alias("t"))
    t, n = undouble_consonants(F.col("t"))
    is_bn, is_en = F.coalesce(F.col("lang") == "bn", F.lit(False)), F.coalesce(F.col("lang") == "en", F.lit(False))
    base = base.select("key", "lang", F.when(is_bn, t).otherwise(F.col("t")).alias("t"), F.when(is_bn, n).otherwise(0).alias("doubled"))
    t, n = restore_bullets(F.col("t"))
    base = base.select("key", "doubled", F.when(is_en, t).otherwise(F.col("t")).alias("t"), F.when(is_en, n).otherwise(0).alias("bullets"))
    joined = join_split_words(base, "key", "t", prefixes)
    out = joined.join(base.select("key", "doubled", "bullets"), "key")
    t, n = tidy_space(F.col("text"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return out.select("key", t.alias("text"), zero("doubled"), zero("bullets"), zero("joined"), F.coalesce(n, F.lit(0)).alias("spaces"))


def repair_references(c: Column) -> Column:
    """Section references that lost their dots: 131 becomes 1.3.1 where the first digit is 1 to 8."""
    return F.regexp_replace(c, LOST_DOTS, "$1.$2.$3")


def references(c: Column) -> Column:
    """The distinct three-part references of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))))
