"""One consistent form for text that looks the same in print (problem 6).

The print form is the composed compatibility form, restricted to decompositions that leave
the glyph as it is (wide, narrow, presentation and no-break forms; a superscript two stays a
superscript two), with default-ignorable characters removed, every special space mapped to
the ordinary one and letters of other scripts that share a Latin glyph mapped to it. It keeps
letter case; `folded` adds full case folding for comparisons that ignore case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.session import staged

# Letters of other scripts drawn like a Latin letter, and signs drawn like another.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j",
    # the palochka, the script g, the Bengali sign drawn like a danda
    "ӏ": "l", "ɡ": "g", "৷": "।",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M",
    "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}

# Vowel letters of Devanagari and Bengali that a letter and a sign, which Unicode doesn't compose, look like.
VOWELS = {
    "अॆ": "ऄ", "अा": "आ", "उु": "ऊ", "एॅ": "ऍ", "एॆ": "ऎ", "एे": "ऐ", "अॉ": "ऑ", "आॅ": "ऑ", "अॊ": "ऒ", "आॆ": "ऒ", "अो": "ओ", "आे": "ओ",
    "अौ": "औ", "आै": "औ", "অা": "আ", "ঋৃ": "ৠ", "ঌৢ": "ৡ",
}
_VOWEL = re.compile("|".join(VOWELS))

# Compatibility decompositions whose result looks different in print.
_VISIBLE_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<font>", "<square>")
# Default-ignorable characters that aren't of category Cf.
_IGNORABLE = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ\U000e0000-\U000e0fff]")
_VIRAMA = "्্੍્୍்్್്"
_JOINER = re.compile(f"(?<![{_VIRAMA}])[‌‍]")
_JOINER_KEPT = {0x200C, 0x200D}
_SOFT_HYPHEN = re.compile("(\\w)?\u00ad([ \\t]*\r?\n[ \\t]*\\w)?")


class _Glyphs(dict):
    """str.translate table that works out a character's form when it is first met."""

    def __missing__(self, cp: int) -> str | int:
        ch = chr(cp)
        if cp < 128 or cp in _JOINER_KEPT or cp == 0xAD:
            out: str | int = cp
        elif unicodedata.category(ch) == "Cf" or _IGNORABLE.match(ch):
            out = ""
        elif unicodedata.category(ch) == "Zs":
            out = " "
        else:
            tag = unicodedata.decomposition(ch).split(" ")[0]
            wide = ch if tag in _VISIBLE_TAGS else unicodedata.normalize("NFKC", ch)
            out = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", wide))
        self[cp] = out
        return out


_GLYPHS = _Glyphs()


def print_form(text: str) -> str:
    """The form shared by all texts that look like this one in print."""
    if text.isascii():
        return text
    if "‌" in text or "‍" in text:
        text = _JOINER.sub("", text)
    if "\u00ad" in text:  # drawn only where it breaks a word over two lines
        text = _SOFT_HYPHEN.sub(lambda m: m[0] if m[1] and m[2] else (m[1] or "") + (m[2] or ""), text)
    text = unicodedata.normalize("NFC", text.translate(_GLYPHS))
    return _VOWEL.sub(lambda m: VOWELS[m[0]], text) if "ऀ" <= max(text, default="") else text


def folded_form(text: str) -> str:
    """The print form under full case folding, for comparisons that ignore letter case."""
    return unicodedata.normalize("NFC", print_form(text).casefold())


def _per_distinct(fn):
    """Apply fn once to each distinct value of an Arrow batch."""

    def apply(values: pa.Array) -> pa.Array:
        d = values.dictionary_encode()
        out = pa.array([None if v is None else fn(v) for v in d.dictionary.to_pylist()], pa.string())
        return out.take(d.indices)

    return apply


@F.arrow_udf(T.StringType())
def _print_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    apply = _per_distinct(print_form)
    for b in batches:
        yield apply(b)


@F.arrow_udf(T.StringType())
def _folded_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    apply = _per_distinct(folded_form)
    for b in batches:
        yield apply(b)


def with_print_form(df: DataFrame, column: str, out: str = "print_form", *, fold: bool = False) -> DataFrame:
    """Add the print form (fold: the case-folded one) of a text column.

    Plain ASCII text is its own form and never leaves the JVM. Null stays null, empty stays empty.
    """
    text = F.col(f"`{column}`").cast("string")
    odd = text.rlike("[^\\x00-\\x7f]")
    udf = _folded_udf if fold else _print_udf
    plain = F.lower(text) if fold else text
    return df.withColumn(out, F.coalesce(udf(F.when(odd, text)), plain))


def _hash128(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of rows whose texts look the same in print but aren't the same code points.

    Returns first_key, second_key (strings, first_key < second_key), each pair once.
    Rows with a null key or null text take no part; a repeated row counts once; an empty
    table gives no pairs. Other columns are ignored, whatever their names.
    Only forms met with at least two spellings are joined: first the spellings of a form with each other, then the rows of
    each on (form, spelling), so every row made is a pair to be returned, whatever the number of exact copies of a spelling,
    and AQE splits what is skewed.
    """
    members = spelt_rows(df, key, text)
    spellings = members.select("form", "spelling").distinct()
    ways = spellings.withColumnRenamed("spelling", "sa").join(spellings.withColumnRenamed("spelling", "sb"), "form").where("sa < sb")
    a = members.select("form", F.col("spelling").alias("sa"), F.col("k").alias("ka"))
    b = members.select("form", F.col("spelling").alias("sb"), F.col("k").alias("kb"))
    pairs = ways.join(a, ["form", "sa"]).join(b, ["form", "sb"]).where("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias("first_key"), F.greatest("ka", "kb").alias("second_key")).distinct()


def spelt_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """k, form, spelling (hashes) of the rows whose form is met with at least two spellings, written once."""
    rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = with_print_form(rows.where("k is not null and t is not null"), "t", "p")
    rows = rows.select("k", _hash128(F.col("p")).alias("form"), _hash128(F.col("t")).alias("spelling"))
    rows = staged(rows, "forms").distinct()
    several = rows.groupBy("form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("form")
    return rows.join(several, "form", "left_semi")


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_id, spellings, members: the rows that lookalike_pairs pairs, one row each with their class, for sets too large to be listed in pairs."""
    rows = spelt_rows(df, key, text)
    sizes = rows.groupBy("form").agg(F.count_distinct("spelling").alias("spellings"), F.count_distinct("k").alias("members"))
    return rows.join(sizes, "form").select(F.col("k").alias("key"), F.lower(F.hex("form")).alias("class_id"), "spellings", "members").distinct()
