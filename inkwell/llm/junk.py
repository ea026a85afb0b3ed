"""Keyword-stuffed and link-list pages (problem 9).

Every line is reduced to a shape: how many words it has, how many between two separators, which separators they are, how many
links, tags, codes and prices, how many words repeat, how many start with a capital, and whether a sentence ends it. Lines of one
shape are grouped, and what a shape holds follows from its fields alone: sentences, or one of the kinds met in junk. A page is
junk when a few shapes that aren't sentences, or sentences into which one phrase is stuffed again and again, hold most of it.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINK = re.compile(r"https?://\S+|www\.\S+")
_MARKUP = re.compile(r"<[^>]*>|\]\([^)]*\)|https?://\S+|www\.\S+")
_WORD = re.compile("[^\\W\\d_ऀ-৿][^\\W\\d_ऀ-৿'’-]*|[ऀ-ॣॱ-ৣৰ-৾]+")
_PIECES = re.compile(r",(?!\d)|[;|>»<!?।॥•·/\[\]()]|\.(?=\s|$)|\s[-–—]\s")
_STOP = re.compile("[.!?।॥][\"”’)\\]]*(?:\\s*\\(\\d+\\))?\\s*$")
_SENTENCE = re.compile("(?<=[.!?।॥])\\s+|\\n+")
_TAG = re.compile(r"(?<!\w)#\w")
_CODE = re.compile(r"\b[A-Z]{2,}-?\d{2,}\b")
_PRICE = re.compile(r"[$€£৳₹¥]\s?\d|★\s?\d")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d*\s*$")
_OPTION = re.compile(r"^\s*(?:[A-Ea-e]|\(?[a-zivx]{1,3}\))[.)]?\s")
_COLUMNS = re.compile(r"\t| {3,}")
#: Kinds of shapes that hold no sentence and are met in junk; the others (contents, columns, options, numbers, remarks) are not counted against a page.
JUNK_KINDS = ("links", "tags", "products", "keywords", "soup", "labels", "stuffed")

# Bounds of the steps in which a field of a shape is counted.
_WORDS = (1, 2, 9, 12, 25, 50, 100, 200, 400)
_BETWEEN = (1, 2, 3, 4, 5.01, 8, 16, 32)
_LONGEST = (1, 5, 8, 16)
_REPEATED = (0.25, 0.5001)
_COUNT = (1, 2, 5, 20)
_CAPITALS = (0.01, 0.5, 0.95)


def _step(bounds: tuple, x: float) -> int:
    return bisect.bisect_right(bounds, x)


class Shape(NamedTuple):
    """Steps of the counts of a line; two lines of one shape can't be told apart by what follows."""

    words: int
    between: int  # words between two separators
    longest: int  # words of the longest piece; where a sentence ends the line, of the longest sentence
    pieces: int
    links: int
    per_link: int  # words for each link
    marks: str  # t tags, c codes, p prices, l leaders, b columns, o option letter, d digits, s a single letter for all words
    repeated: int  # share of the words that were there before
    capitals: int
    ended: bool
    again: bool = False  # the page repeats the words of such lines, or stuffs them with one phrase

    @property
    def kind(self) -> str:
        got = _KINDS.get(self)
        if got is None:
            got = _KINDS[self] = self._kind()
        return got

    def _kind(self) -> str:
        if self.links:
            return "remark" if self.ended and self.longest >= 2 and self.per_link >= 2 else "links"
        if "t" in self.marks:
            return "tags"
        if "c" in self.marks and "p" in self.marks:
            return "products"
        if "l" in self.marks:
            return "contents"
        if "b" in self.marks and "d" in self.marks:
            return "columns"
        if self.words == 0 or (self.words == 1 and "d" in self.marks and "s" in self.marks):
            return "number"
        if self.words >= 4 and self.pieces >= 3 and self.between <= 4 and self.longest <= 2 and self.repeated >= 1:
            return "keywords"
        if self.words >= 4 and self.repeated >= 2 and not self.ended:
            return "soup"
        if "o" in self.marks and self.words <= 2:
            return "option"
        if self.words <= 2 and not self.ended:
            return "labels" if self.again else "label"
        return "stuffed" if self.again else "text"

    def __str__(self) -> str:
        numbers = "".join(f"{c}{getattr(self, f)}" for c, f in zip("wblsknrc", ("words", "between", "longest", "pieces", "links", "per_link", "repeated", "capitals")))
        return f"{numbers}{'e' if self.ended else ''}{'a' if self.again else ''}{':' + self.marks if self.marks else ''}"


_KINDS: dict[Shape, str] = {}  # shapes met so far; there are at most a few thousand
_DIGIT = re.compile(r"\d")
_SEPARATOR = re.compile(r"[,;|>»<!?।॥•·/\[\]().–—-]")


def line_shape(line: str) -> tuple[Shape, list[str]]:
    """Shape and words of a line."""
    links = len(_LINK.findall(line)) if "http" in line or "www." in line else 0
    body = _MARKUP.sub(" ", line) if links or "<" in line or "](" in line else line
    found = _WORD.findall(body)
    words = [w.lower() for w in found]
    n = len(found)
    pieces = [n]
    if _SEPARATOR.search(body):
        pieces = [k for k in (len(_WORD.findall(p)) for p in _PIECES.split(body)) if k] or [0]
    ended = _STOP.search(body) is not None
    if links:
        longest = max((len(_WORD.findall(p)) for p in _SENTENCE.split(body)), default=0)
    else:
        longest = max(pieces)
    digits = _DIGIT.search(body) is not None
    marks = ""
    if "#" in body and (tags := len(_TAG.findall(body))) and 2 * tags >= len(body.split()):
        marks += "t"
    if digits and _CODE.search(body):
        marks += "c"
    if digits and _PRICE.search(body):
        marks += "p"
    if "." in body and _LEADER.search(body):
        marks += "l"
    if ("\t" in body or "   " in body) and _COLUMNS.search(body.strip()):
        marks += "b"
    if _OPTION.match(line):
        marks += "o"
    if digits:
        marks += "d"
    if n == 1 and len(words[0]) == 1:
        marks += "s"
    capitals = sum(w[0].isupper() for w in found) / n if n else 0.0
    repeated = 1 - len(set(words)) / n if n else 0.0
    shape = Shape(
        _step(_WORDS, n), _step(_BETWEEN, n / len(pieces)), _step(_LONGEST, longest), _step(_COUNT, len(pieces)), _step(_COUNT, links), _step((1, 8.01), n / links) if links else 0,
        marks, _step(_REPEATED, repeated), _step(_CAPITALS, capitals), ended,
    )
    return shape, words


def _stuffed(text: str, words: list[str]) -> bool:
    """One phrase of three words holds a fifth of the words and comes more than once a sentence."""
    if len(words) < 15:
        return False
    phrase, times = Counter(zip(words, words[1:], words[2:])).most_common(1)[0]
    if times < 4 or 3 * times < 0.2 * len(words):
        return False
    told = sum(1 for s in _SENTENCE.split(text) if len(_WORD.findall(s)) >= 4)
    return times >= 1.5 * max(1, told)


def page_shapes(text: str) -> dict[Shape, list[int]]:
    """shape -> [lines, characters] of a page."""
    seen: dict[Shape, list[int]] = {}
    labels: list[str] = []
    prose: list[str] = []
    prose_words: list[str] = []
    lines = 0
    for line in text.split("\n"):
        if not line.strip():
            continue
        shape, words = line_shape(line)
        if shape.kind == "label":
            labels += words
            lines += 1
        elif shape.kind in ("text", "soup", "keywords"):
            prose.append(line)
            prose_words += words
        got = seen.setdefault(shape, [0, 0])
        got[0] += 1
        got[1] += len(line)
    repeating = {"label": lines >= 8 and len(set(labels)) <= 0.7 * len(labels), "text": bool(prose) and _stuffed("\n".join(prose), prose_words)}
    return {shape._replace(again=repeating.get(shape.kind, False)): got for shape, got in seen.items()}


def line_shapes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, shape, lines, chars: the shapes of every page, counted within the page before they are shuffled."""

    def run(batches):
        for b in batches:
            ids, kinds, shapes, lines, chars = [], [], [], [], []
            for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for shape, (n, c) in page_shapes(page).items():
                    ids.append(key)
                    kinds.append(shape.kind)
                    shapes.append(str(shape))
                    lines.append(n)
                    chars.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(shapes, pa.string()), pa.array(lines, pa.int64()), pa.array(chars, pa.int64())],
                names=["doc_id", "kind", "shape", "lines", "chars"],
            )

    src = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, kind string, shape string, lines long, chars long")


def judged_pages(df: DataFrame, key: str = "doc_id", text: str = "text", *, min_share: float = 0.5, few: int = 4) -> DataFrame:
    """doc_id, chars, junk_share, few_share, top_kind, top_shape, is_junk for every page with at least one character that isn't blank.

    junk_share: share of the characters on lines of shapes of junk; few_share: the share that the `few` largest of these
    shapes hold, which decides: a page is junk when it reaches min_share. Null, empty and blank texts give no row;
    repeated rows of a page count together, which leaves the shares as they are.
    """
    junk = F.col("kind").isin(*JUNK_KINDS)
    by_shape = line_shapes(df, key, text).groupBy("doc_id", "kind", "shape").agg(F.sum("chars").alias("chars"))
    sizes = F.sort_array(F.collect_list(F.when(junk, F.struct("chars", "kind", "shape"))), asc=False)
    pages = by_shape.groupBy("doc_id").agg(F.sum("chars").alias("chars"), sizes.alias("sizes"))
    total = lambda c: F.aggregate(F.transform(c, lambda x: x["chars"]), F.lit(0).cast("long"), lambda s, x: s + x)
    pages = pages.withColumn("junk_share", total(F.col("sizes")) / F.col("chars"))
    pages = pages.withColumn("few_share", total(F.slice("sizes", 1, few)) / F.col("chars"))
    top = [F.expr(f"get(sizes, 0).{f}").alias(f"top_{f}") for f in ("kind", "shape")]
    return pages.select("doc_id", "chars", "junk_share", "few_share", *top, (F.col("few_share") >= min_share).alias("is_junk"))


def junk_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """kind, shape, pages, junk, few_share: pages by the shape of junk that holds most of them, how many of them are junk, and their mean share."""
    judged = judged_pages(df, key, text).where("top_shape is not null")
    groups = judged.groupBy(F.col("top_kind").alias("kind"), F.col("top_shape").alias("shape"))
    return groups.agg(F.count("*").alias("pages"), F.count_if("is_junk").alias("junk"), F.round(F.avg("few_share"), 6).alias("few_share"))


def junk_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id of the pages flagged by judged_pages, each once."""
    return judged_pages(df, key, text).where("is_junk").select("doc_id").distinct()
