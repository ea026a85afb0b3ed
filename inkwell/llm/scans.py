"""Noise in text from scanned pages (problem 5).

One pass over the texts reduces every page to candidates: lines that are furniture by their form (print codes, ruled space,
mirrored, letter-spaced or one-word-a-line notices), numbers at page edges, short lines that may be running
heads or feet, line ends that may be half a word, and tokens outside the common vocabulary. Everything that needs
the rest of the corpus is then decided by joins on the candidates, never by shuffling the texts:

- running heads and feet: the line's skeleton, which misreadings leave as it is, is that of the document's title, or comes
  back at the edge of several pages or in several texts of the document; a line set in capitals or wide blanks alone is text;
- page numbers: the difference between the printed number and the page is the same on several pages of the document;
- notices: a phrase printed in an odd direction somewhere is furniture wherever it stands;
- hyphens: the joined word, or else the hyphenated one, is in the corpus vocabulary;
- misreadings: a word outside the vocabulary has the skeleton of a word inside it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.session import staged

HYPHENS = "-‐­¬"
_LETTER = "[^\\W\\d_]"
_WORD = re.compile("[^\\W_\\u0900-\\u09ff]+|[\\u0900-\\u0963\\u0971-\\u09e3\\u09f0-\\u09fe]+")
_CHUNK = re.compile("\\S+")
_EDGE = ".,;:?!()[]\"“”।॥–—•*|'’‘"
_CLOSING = _EDGE.replace("(", "")
_INDIC = re.compile("[ऀ-৿]")
_CODE = re.compile(r"^\*?[A-Z0-9]{1,2}\d{4,}[A-Z]\d{2,}[A-Z]?\*?$")
_RULED = re.compile(r"^[.…_\-–—·\s]{6,}$")
_NUMBER = re.compile(r"^[^\w%]*(?:(?:page|pg?\.|seite|página|pagina|পৃষ্ঠা|पृष्ठ)\s*)?(\d{1,4})(?:\s*/\s*\d{1,4})?[^\w%]*$", re.I)
_PAGE_BEFORE = re.compile(r"^\W*(\d{1,4})\W*(?:\s{2,}|\s*\|\s*)(\D.*)$")
_PAGE_AFTER = re.compile(r"^(.*\S)(?:\s{2,}|\s*\|\s*)(\d{1,4})\W*$")
_TITLE_NUMBER = re.compile(r"^([^.,;:=()\[\]]*\S)\s+(\d{1,2})$")
_WIDE = re.compile(r"^\S+(?: {2,}\S+)+$")
_INSIDE_MARK = re.compile(f"(?<={_LETTER})\\((?={_LETTER})")
_STOP = re.compile("[.!?।॥:;,][\"”’)\\]]*\\s*$")
_LEADERS = re.compile(r"\s[\s.…_]*[.…_]\s*$|[.…_]{3,}\s*$")
_DIGIT_FOR = str.maketrans("li|oszgqb", "111052996")
_SPACED = re.compile(r"^(?:\S ){5,}\S$")
_SPLIT_INSIDE = re.compile(f"({_LETTER}[\\w\\u0900-\\u09ff]*)[{HYPHENS}] ({_LETTER}[\\w\\u0900-\\u09ff]*)")
_DIGITS = {ord(c): str(unicodedata.digit(c)) for c in "০১২৩৪৫৬৭৮৯०१२३४५६७८९"}

# Sequences and characters that scanners take for one another.
SEQUENCES = (("li", "h"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("rt", "n"), ("tt", "h"))
LOOK_ALIKE_CLASSES = ("ec(", "tf", "il1|!", "o0", "s5$", "a@", "hb6", "gq9", "রব", "যষ", "তভ", "নলণ", "মস", "থখ", "मभ", "धघ", "वब", "षप")
_CLASS = {ord(c): group[0] for group in LOOK_ALIKE_CLASSES for c in group}
_DOUBLED = re.compile("([\u0995-\u09b9\u0915-\u0939]\u09bc?)\\1+")


def _spelling(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def _class_first(w: str) -> str:
    """Classes first, then SEQUENCES as the classes show them (cl as ei, li as ii); li and ii look the same there, so u and h do."""
    s = w.translate(_CLASS)
    for wrong, right in (("ii", "u"), ("ri", "n"), ("rt", "n"), ("rn", "m"), ("ei", "d"), ("vv", "w"), ("tt", "h"), ("u", "h")):
        s = s.replace(wrong, right)
    return s


def skeletons(word: str) -> tuple[str, ...]:
    """Forms that a word shares with its likely misreadings; they differ in what is folded first."""
    w = _spelling(word)
    if _INDIC.search(w):
        return (_DOUBLED.sub("\\1", w.translate(_CLASS)),)
    out = [_class_first(w)]
    for order in (SEQUENCES, SEQUENCES[3:] + SEQUENCES[:3]):
        s = w
        for wrong, right in order:
            s = s.replace(wrong, right)
        out.append("~" + s.translate(_CLASS))
    return tuple(dict.fromkeys(out))


@lru_cache(maxsize=1 << 17)
def _first_skeleton(word: str) -> str:
    w = _spelling(word)
    return _DOUBLED.sub("\\1", w.translate(_CLASS)) if _INDIC.search(w) else _class_first(w)


def line_skeleton(line: str) -> str:
    """Skeleton of a whole line: case, blanks, leaders and misreadings folded; digits kept."""
    line = _INSIDE_MARK.sub("c", _LEADERS.sub("", line).translate(_DIGITS).replace("@", "a").replace("$", "s"))
    return " ".join(w if w.isdigit() else _first_skeleton(w) for w in _WORD.findall(line))


_INNER = re.compile(r"['’/–—-]")


@lru_cache(maxsize=1 << 17)
def _parts(word: str) -> tuple[str, ...]:
    return tuple(_spelling(part) for part in _INNER.split(word) if part and part != "(")


def tokens(line: str) -> list[str]:
    """Words of a line in lower case, without the punctuation around them; marks inside a word stay."""
    out = []
    found = _CHUNK.findall(line)
    for k, raw in enumerate(found):
        if raw.isalpha():
            out += _parts(raw)
            continue
        w = raw.lstrip(_EDGE).rstrip(_CLOSING + HYPHENS)
        if w.endswith("("):  # a c misread as a bracket, unless nothing but the bracket is there
            w = w if len(w) > 1 and w[-2].isalpha() else w[:-1]
        if raw[0] == "(" and len(w) > 1 and w[0].isalpha() and not any(")" in x for x in found[k:]):
            w = "(" + w
        out += _parts(w)
    return out


def misread_number(word: str) -> bool:
    """Digits and letters that look like digits, and nothing else."""
    bare = word.replace(",", "").replace(".", "")
    return len(bare) > 1 and any(map(str.isdigit, bare)) and not bare.isdigit() and bare.translate(_DIGIT_FOR).isdigit()


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """word, n: how often each word occurs in a text column (words of at least two characters or one letter, no numbers).

    Counted per batch before the shuffle. Null texts count for nothing.
    """

    def count(batches):
        for b in batches:
            got: Counter = Counter()
            for t in b.column(0).to_pylist():
                got.update(re.split(r"['’/–—\s\-]+", t.lower()))
            words: Counter = Counter()
            for w, n in got.items():
                w = _spelling(w.strip(_EDGE + HYPHENS))
                if w and not any(c.isdigit() for c in w):
                    words[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    src = df.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compounds(df: DataFrame, text: str) -> DataFrame:
    """word, n: hyphenated words that stand inside a line of a text column."""
    found = F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text}`").cast("string")), F.lit(r"(\p{L}[\p{L}\p{M}]*-\p{L}[\p{L}\p{M}]*)"), F.lit(1)))
    return df.select(found.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_CANDIDATES = (
    "tbl string, row_key string, doc string, page int, line_no int, kind string, place string, skeleton string, word string, "
    "next array<struct<line_no:int,word:string>>"
)
_NEXT = pa.list_(pa.struct([("line_no", pa.int32()), ("word", pa.string())]))


def _title_like(line: str) -> bool:
    first = next((c for c in line if c.isalpha()), "")
    return bool(first) and (first.isupper() or bool(_INDIC.match(first)))


def _first_word(line: str) -> str:
    """The first word of a line, or nothing where it doesn't start with a letter."""
    found = _CHUNK.search(line)
    w = _spelling(_INNER.split(found[0].strip(_EDGE))[0]) if found else ""
    return w if w and (w[0].isalpha() or _INDIC.match(w[0])) else ""


def _lone_value(lines: list[str], filled: list[int], i: int) -> bool:
    """Whether a bare number may be the author's: alone in its text, after a question, colon or equals sign, or among other values."""
    k = filled.index(i)
    before = lines[filled[k - 1]].strip() if k else ""
    after = lines[filled[k + 1]].strip() if k + 1 < len(filled) else ""
    values = [x for x in (before, after) if x and not any(map(str.isalpha, x)) and any(map(str.isdigit, x)) and not (x[0] == "(" and x[-1] == ")")]
    return len(filled) == 1 or before[-1:] in "?:=" and bool(before) or bool(values)


def _breaks_in(lines: list[str], filled: list[int], i: int) -> bool:
    """Whether a line stands inside a running sentence, or beside a page number, where no heading of the author's can be."""
    k = filled.index(i)
    before = lines[filled[k - 1]].strip() if k else ""
    after = lines[filled[k + 1]].strip() if k + 1 < len(filled) else ""
    beside = [x.translate(_DIGITS) for x in (before, after) if len(x) <= 16]
    return bool(before) and after[:1].islower() or any(_NUMBER.match(x) and not x.isdigit() and not (x[0] == "(" and x[-1] == ")") for x in beside if x)


def page_candidates(text: str, page: int | None, common: frozenset, known: frozenset, paged: bool) -> list[tuple]:
    """(line_no, kind, place, skeleton, word, next) of a page; kinds: furniture, notice, number, short, hyphen, opening, token."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    edge = {}
    for rank, i in enumerate(filled[:3]):
        edge[i] = ("top", rank)
    for rank, i in enumerate(reversed(filled[-3:])):
        edge.setdefault(i, ("foot", rank))
    out: list[tuple] = []
    gone: set[int] = set()

    # notices printed one word a line
    run: list[int] = []
    for i in [*range(len(lines)), None]:
        word = lines[i].strip() if i is not None else ""
        if i is not None and len(word) >= 2 and not _CHUNK.sub("", word) and word.isupper() and sum(map(str.isalpha, word)) > len(word) / 2 and not _CODE.match(word):
            run.append(i)
            continue
        if run and i is not None and (not word or word.isdigit() or _CODE.match(word) or _RULED.match(word)):
            continue  # what the layout put between the words
        if len(run) >= 3:
            phrase = line_skeleton(" ".join(lines[j].strip() for j in run))
            for j in run:
                out.append((j + 1, "furniture", "", None, None, None))
                gone.add(j)
            out.append((run[0] + 1, "notice", "", phrase, None, None))
        run = []

    for i in filled:
        if i in gone:
            continue
        line = lines[i]
        bare = line.strip()
        at, rank = edge.get(i, ("", 9))
        plain = bare if bare.isascii() else bare.translate(_DIGITS)
        number = _NUMBER.match(plain) if len(plain) <= 16 and not (plain[0] == "(" and plain[-1] == ")") else None
        if _CODE.match(bare) or _RULED.match(bare) or (number and not (paged and page is not None) and (not plain.isdigit() or not _lone_value(lines, filled, i))):
            out.append((i + 1, "furniture", at, None, None, None))
            gone.add(i)
            continue
        if number and paged and page is not None and at:
            out.append((i + 1, "number", at, None, number[1], None))
            gone.add(i)
            continue
        if _SPACED.match(bare) and bare.replace(" ", "").isalpha():
            out += [(i + 1, "furniture", at, None, None, None), (i + 1, "notice", at, "~" + line_skeleton(bare.replace(" ", "")), None, None)]
            gone.add(i)
            continue
        words = _WORD.findall(bare)
        if 2 <= len(words) <= 10 and bare.isascii():
            low = [w.lower() for w in words]
            back = [w[::-1] for w in low]
            if sum(w in known for w in back) > len(words) / 2 and sum(w in known for w in low) < len(words) / 2:
                phrase = line_skeleton(bare[::-1])
                out += [(i + 1, "furniture", at, None, None, None), (i + 1, "notice", at, phrase, None, None)]
                gone.add(i)
                continue
            if 2 * sum(w in known for w in low) <= len(words):  # perhaps a mirrored notice whose words are rare
                out.append((i + 1, "short", "", line_skeleton(bare[::-1]), "mirrored", None))
        if 1 <= len(words) <= 10 and not _STOP.search(_LEADERS.sub("", bare)) and bare[0] not in "(•*–-":
            if paged and page is not None and rank <= 1:
                cut, front = _PAGE_AFTER.match(plain), _PAGE_BEFORE.match(plain)
                for body, printed in [(m[k], m[3 - k]) for m, k in ((cut, 1), (front, 2)) if m]:
                    out.append((i + 1, "number", at, None, printed, None))
                    out.append((i + 1, "short", at, line_skeleton(body), "set", None))
            titled = plain[-1].isdigit() and _TITLE_NUMBER.match(plain)
            titled = titled and len(words) <= 8 and _title_like(bare) and all(any(map(str.isalpha, w)) for w in titled[1].split()) and sum(map(str.isalpha, bare)) >= 2
            capitals = bare.isupper() and sum(map(str.isupper, bare)) >= 3
            wide = "  " in bare and _WIDE.match(bare) and not re.search(r"\d[.,]\d+$", bare)
            set_off = len(words) <= 8 and (capitals or wide) and sum(map(str.isalpha, bare)) >= 3
            if (titled or set_off) and (not paged or rank <= 1):
                if not (paged and page is not None) and _breaks_in(lines, filled, i):
                    out.append((i + 1, "furniture", at, None, None, None))
                    gone.add(i)
                out.append((i + 1, "short", at, line_skeleton(plain), "titled" if titled else "set", None))
                continue
            if len(words) <= 8:
                out.append((i + 1, "short", at if rank <= 1 else "", line_skeleton(plain), None, None))

    order = [i for i in filled if i not in gone]
    if paged and page is not None:
        out += [(i + 1, "opening", "", None, w, None) for i in order[:4] if (w := _first_word(lines[i]))]
    pieces: dict[int, list[str]] = {}
    for k, i in enumerate(order):
        line = lines[i]
        stripped = line.rstrip()
        found = tokens(stripped)
        last = stripped[-1:] if len(stripped) > 1 else ""
        broken = last and last in HYPHENS and (stripped[-2].isalpha() or _INDIC.match(stripped[-2])) and found
        if broken:
            after = [{"line_no": j + 1, "word": w} for j in order[k + 1 : k + 13] if (w := _first_word(lines[j]))]
            if after or paged:
                left = re.split(r"['’/–—\-]", stripped.rstrip(HYPHENS).split()[-1].strip(_EDGE))[-1]
                out.append((i + 1, "hyphen", last, None, _spelling(left), after))
        for m in _SPLIT_INSIDE.finditer(stripped):
            out.append((i + 1, "hyphen", "inside", None, _spelling(m[1]), [{"line_no": i + 1, "word": _spelling(m[2])}]))
        pieces[i] = found
        for w in dict.fromkeys(found):
            if w not in common and len(w) > 1:
                if not w.isalpha() and w.replace(",", "").replace(".", "").isdigit():
                    continue
                out.append((i + 1, "token", "number" if misread_number(w) else "", None, w, None))
    return out


def candidates(texts: DataFrame, common: list[str], known: list[str]) -> DataFrame:
    """The candidates of every text; texts has tbl, row_key, doc, page, text. known: the common words that the reference has."""
    held = texts.sparkSession.sparkContext.broadcast((frozenset(common), frozenset(known)))

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]
            for tbl, key, doc, page, text in zip(*(c.to_pylist() for c in b.columns)):
                for line_no, kind, place, skeleton, word, nxt in page_candidates(text, page, *held.value, tbl == "ocr_pages"):
                    for c, v in zip(cols, (tbl, key, doc, page, line_no, kind, place, skeleton, word, nxt)):
                        c.append(v)
            kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 4 + [_NEXT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["tbl", "row_key", "doc", "page", "line_no", "kind", "place", "skeleton", "word", "next"],
            )

    return texts.mapInArrow(run, _CANDIDATES)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _skeletons_udf(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else list(dict.fromkeys(skeletons(w))) for w in words.to_pylist()], pa.list_(pa.string()))


_ROW = ["tbl", "row_key"]


_CORE = "^[0-9 ]+|[0-9 ]+$"


def page_numbers(found: DataFrame, *, min_pages: int = 2) -> DataFrame:
    """tbl, row_key, line_no of numbers at page edges that run on with the pages: their distance from the page comes back on
    min_pages pages of the document, or is none."""
    numbers = found.where("kind = 'number' and page is not null").withColumn("offset", F.col("word").try_cast("int") - F.col("page")).where("offset is not null")
    runs = numbers.where("offset <> 0 and doc is not null").groupBy("doc", "offset").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    shifted = numbers.join(runs.select("doc", "offset"), ["doc", "offset"], "left_semi")
    return numbers.where("offset = 0").select(*_ROW, "line_no").unionByName(shifted.select(*_ROW, "line_no")).distinct()


def furniture_lines(found: DataFrame, titles: DataFrame | None = None, *, min_pages: int = 2, min_documents: int = 3, near: float = 0.2) -> DataFrame:
    """tbl, row_key, line_no of the lines that belong to the printed page. titles: doc and skeleton of the documents' titles."""
    sure = found.where("kind = 'furniture'").select(*_ROW, "line_no").unionByName(page_numbers(found, min_pages=min_pages))
    short = found.where("kind = 'short' and skeleton <> ''").withColumn("core", F.regexp_replace("skeleton", _CORE, ""))
    # lines set off by capitals, wide blanks or a number behind them: the title, or words that come back
    formed = short.where("word in ('set', 'titled') and doc is not null")
    row = F.xxhash64(*_ROW)
    several = [F.min(row).alias("lo"), F.max(row).alias("hi")]
    texts = short.where("core <> '' and doc is not null and coalesce(word, '') <> 'mirrored'").groupBy("doc", "core").agg(*several)
    same = short.where("word = 'titled' and doc is not null").groupBy("doc", "skeleton").agg(*several)
    wide = texts.groupBy("core").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_documents)
    again = formed.where("word = 'set' and core <> ''").join(texts.where("lo <> hi"), ["doc", "core"], "left_semi").select(*_ROW, "line_no")
    again = again.unionByName(formed.where("word = 'titled'").join(same.where("lo <> hi"), ["doc", "skeleton"], "left_semi").select(*_ROW, "line_no"))
    again = again.unionByName(short.where("word = 'set' and place <> '' and core <> ''").join(wide, "core", "left_semi").select(*_ROW, "line_no"))
    if titles is not None:
        of = titles.select("doc", F.col("skeleton").alias("title")).where("title <> ''")
        met = formed.join(of, "doc").where(F.levenshtein("skeleton", "title") <= F.floor(near * F.length("title")))
        again = again.unionByName(met.select(*_ROW, "line_no"))
    # heads and feet come back at the edge of several pages of a document; without a number or a form that sets them
    # off from the text, on pages of one side
    edges = short.where("tbl = 'ocr_pages' and place in ('top', 'foot') and doc is not null")
    repeated = edges.groupBy("doc", "place", "skeleton").agg(
        F.count_distinct("page").alias("pages"),
        F.max(F.col("skeleton").rlike("[0-9]") | F.coalesce(F.col("word").isin("set", "titled"), F.lit(False))).alias("sure"),
        F.min(F.pmod("page", F.lit(2))).alias("low"),
        F.max(F.pmod("page", F.lit(2))).alias("high"),
    )
    heads = repeated.where(F.col("pages") >= min_pages).where("place = 'foot' or sure or low = high or pages > 3").select("doc", "place", "skeleton")
    in_pages = edges.join(heads, ["doc", "place", "skeleton"], "left_semi").select(*_ROW, "line_no")
    # where the page isn't known, a line with the skeleton of a head or of the title of its document
    known = heads.where("place = 'top' and skeleton rlike '[0-9]'").select("doc", "skeleton")
    if titles is not None:
        known = known.unionByName(titles.where("skeleton rlike '[0-9]'").select("doc", "skeleton"))
    loose = short.where("tbl <> 'ocr_pages' and doc is not null")
    in_pages = in_pages.unionByName(loose.join(known.distinct(), ["doc", "skeleton"], "left_semi").select(*_ROW, "line_no"))
    # phrases that are feet of several documents, or are printed in an odd direction, are furniture wherever they stand
    feet = heads.where("place = 'foot' and skeleton rlike ' '").groupBy("skeleton").agg(F.count_distinct("doc").alias("n"))
    feet = feet.where(F.col("n") >= min_documents).select("skeleton")
    notices = found.where("kind = 'notice'").groupBy("skeleton").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents)
    spaced = notices.where("skeleton like '~%'").select(F.substring("skeleton", 2, 1 << 20).alias("solid"))
    phrases = notices.where("skeleton not like '~%'").select("skeleton").unionByName(feet).distinct()
    anywhere = short.join(phrases, "skeleton", "left_semi").select(*_ROW, "line_no")
    # a word of a notice that stands alone on its line, in capitals
    pieces = phrases.select(F.explode(F.split("skeleton", " ")).alias("skeleton")).distinct()
    anywhere = anywhere.unionByName(short.where("word = 'set' and not contains(skeleton, ' ')").join(pieces, "skeleton", "left_semi").select(*_ROW, "line_no"))
    solid = short.withColumn("solid", F.replace(F.col("skeleton"), F.lit(" "), F.lit("")))
    anywhere = anywhere.unionByName(solid.join(spaced, "solid", "left_semi").select(*_ROW, "line_no"))
    return sure.unionByName(again).unionByName(in_pages).unionByName(anywhere).distinct()


@F.arrow_udf(T.StringType())
def _line_skeleton_udf(lines: pa.Array) -> pa.Array:
    return pa.array([None if x is None else line_skeleton(x.translate(_DIGITS)) for x in lines.to_pylist()], pa.string())


def title_skeletons(documents: DataFrame, key: str, title: str) -> DataFrame:
    """doc, skeleton of the titles of documents; rows without either are left out."""
    rows = documents.where(F.col(key).isNotNull() & F.col(title).isNotNull())
    return rows.select(F.col(key).cast("string").alias("doc"), _line_skeleton_udf(F.col(title)).alias("skeleton")).distinct()


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The rows of words (word, n) whose n is so large that at most about `most` have it: cut by counts in steps of a quarter power of two."""
    step = F.floor(F.log2("n") * 4).cast("int")
    sizes = words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()  # at most 256 rows
    cut, seen = None, 0
    for r in sizes:
        if cut is not None and seen + r.words > most:
            break
        cut, seen = r.step, seen + r.words
    return words.where(step >= F.lit(cut if cut is not None else 0))


def broken_words(found: DataFrame, furniture: DataFrame, words: DataFrame, joined_by_hyphen: DataFrame) -> DataFrame:
    """tbl, row_key, line_no, next_key, next_line, left_piece, right_piece, joined, broken: words on two lines.

    The second line is the next one of the text that isn't furniture, or else the first such line of the document's next page.
    broken: the layout broke the word and put in the hyphen; else the hyphen is part of a known compound.
    """
    base = found.where("kind = 'hyphen'").select(*_ROW, "doc", "page", "line_no", "place", F.col("word").alias("left_piece"), "next")
    base = base.join(furniture, [*_ROW, "line_no"], "left_anti")
    near = base.select(*_ROW, "line_no", "place", "left_piece", F.posexplode("next").alias("k", "n"))
    near = near.select(*_ROW, "line_no", "place", "left_piece", "k", F.col("n.line_no").alias("next_line"), F.col("n.word").alias("right_piece"))
    near = near.join(furniture.withColumnRenamed("line_no", "next_line"), [*_ROW, "next_line"], "left_anti")
    near = near.groupBy(*_ROW, "line_no", "place", "left_piece").agg(F.min(F.struct("k", "next_line", "right_piece")).alias("n"))
    near = near.select(*_ROW, "line_no", "place", "left_piece", F.col("row_key").alias("next_key"), "n.next_line", "n.right_piece")
    ends = base.where("tbl = 'ocr_pages' and place <> 'inside' and doc is not null and page is not null").drop("next")
    ends = ends.join(near.select(*_ROW, "line_no", "left_piece"), [*_ROW, "line_no", "left_piece"], "left_anti")
    opens = found.where("kind = 'opening' and doc is not null").join(furniture, [*_ROW, "line_no"], "left_anti")
    opens = opens.groupBy("tbl", "doc", (F.col("page") - 1).alias("page")).agg(F.min(F.struct("row_key", "line_no", "word")).alias("o"))
    over = ends.join(opens, ["tbl", "doc", "page"])
    over = over.select(*_ROW, "line_no", "place", "left_piece", F.col("o.row_key").alias("next_key"), F.col("o.line_no").alias("next_line"), F.col("o.word").alias("right_piece"))
    cand = near.unionByName(over).withColumn("joined", F.concat("left_piece", "right_piece"))
    cand = cand.withColumn("linked", F.concat("left_piece", F.lit("-"), "right_piece"))
    whole = words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    link = joined_by_hyphen.select(F.col("word").alias("linked"), F.col("n").alias("n_linked"))
    right = words.select(F.col("word").alias("right_piece"), F.col("n").alias("n_right"))
    left = words.select(F.col("word").alias("left_piece"), F.col("n").alias("n_left"))
    c = cand.join(whole, "joined", "left").join(link, "linked", "left").join(right, "right_piece", "left").join(left, "left_piece", "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    known = (n("n_joined") >= 2) & (n("n_joined") >= n("n_linked"))
    # neither form is known: a break, unless both pieces are words of their own (a hanging hyphen, an unknown compound)
    neither = (n("n_joined") < 2) & (n("n_linked") < 1) & (F.col("place") != "inside") & ~((n("n_left") >= 2) & (n("n_right") >= 2))
    compound = (n("n_linked") >= 1) & (F.col("place") != "inside")
    c = c.withColumn("broken", known | neither).where(F.col("broken") | compound)
    return c.select(*_ROW, "line_no", "next_key", "next_line", "left_piece", "right_piece", "joined", "broken")


def trusted_words(reference: DataFrame, scanned: DataFrame, *, min_count: int = 5, times: int = 5) -> DataFrame:
    """word, n, known (in the reference): the reference vocabulary, and words met only in the scanned texts that outnumber all others of their skeleton."""
    own = scanned.where(F.col("n") >= min_count).join(reference.select("word"), "word", "left_anti")
    own = own.select("word", "n", F.explode(_skeletons_udf("word")).alias("skeleton"))
    ref = reference.select(F.explode(_skeletons_udf("word")).alias("skeleton")).distinct()
    own = own.join(ref, "skeleton", "left_anti")
    rivals = own.groupBy("skeleton").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    own = own.join(rivals, "skeleton").where((F.col("n") == F.col("most")) & (F.col("n") * times >= (F.col("all") - F.col("n")) * times**2))
    # every skeleton of the word has to be its own
    count = scanned.select("word", F.size(_skeletons_udf("word")).alias("k"))
    own = own.groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("got")).join(count, "word").where("got = k").select("word", "n")
    return reference.select("word", "n", F.lit(True).alias("known")).unionByName(own.withColumn("known", F.lit(False)))


def misread_words(tokens_found: DataFrame, words: DataFrame) -> DataFrame:
    """word, correction: words outside the vocabulary that have the skeleton of a word inside it (the most frequent one)."""
    unknown = tokens_found.select("word").distinct().join(words.select("word"), "word", "left_anti")
    unknown = unknown.select("word", F.explode(_skeletons_udf("word")).alias("skeleton"))
    known = words.select(F.col("word").alias("correction"), "n", F.explode(_skeletons_udf("word")).alias("skeleton"))
    best = known.groupBy("skeleton").agg(F.max(F.struct("n", "correction")).alias("b"))
    met = unknown.join(best, "skeleton").groupBy("word").agg(F.max("b").alias("b"))
    return met.select("word", F.col("b.correction").alias("correction"))


class Findings:
    """What was found in a set of texts; see find()."""

    def __init__(self, furniture: DataFrame, hyphens: DataFrame, links: DataFrame, misread: DataFrame):
        self.furniture, self.hyphens, self.links, self.misread = furniture, hyphens, links, misread


def find(texts: DataFrame, reference: DataFrame, reference_text: str, titles: DataFrame | None = None, *, common_words: int = 100_000) -> Findings:
    """Furniture, broken words and misread words of texts (tbl, row_key, doc, page, text); titles (doc, skeleton) are those of the documents.

    The vocabulary is counted over all of `reference`. Only its `common_words` most frequent words are sent to the
    tasks, where they spare a shuffle of tokens that need no second look; every other token is looked up by a join
    with the whole vocabulary. Null keys and null texts take no part; empty texts and tables give no findings;
    repeated rows give each finding once.
    """
    src = texts.select(*_ROW, "doc", "page", "text").where("row_key is not null and text is not null")
    known = staged(vocabulary(reference, reference_text).where("n >= 2"), "reference")
    words = staged(trusted_words(known, vocabulary(src, "text")), "vocabulary")
    linked = staged(compounds(reference, reference_text), "compounds")
    top = most_frequent(words, common_words).collect()
    found = staged(candidates(src, [r.word for r in top], [r.word for r in top if r.known]), "candidates", by="kind")
    furniture = staged(furniture_lines(found, titles), "furniture")
    over_two = staged(broken_words(found, furniture, words, linked), "hyphens")
    hyphens, links = over_two.where("broken"), over_two.where("not broken")

    token = found.where("kind = 'token'").select(*_ROW, "line_no", "word", "place")
    numbers = token.where("place = 'number'").join(furniture, [*_ROW, "line_no"], "left_anti")
    numbers = numbers.join(words.select("word"), "word", "left_anti").select(*_ROW, "line_no", "word", F.translate("word", "li|oszgqb", "111052996").alias("correction"))
    token = token.where("place <> 'number'").join(furniture, [*_ROW, "line_no"], "left_anti")
    halves = hyphens.select(*_ROW, "line_no", F.col("left_piece").alias("word")).unionByName(
        hyphens.select("tbl", F.col("next_key").alias("row_key"), F.col("next_line").alias("line_no"), F.col("right_piece").alias("word"))
    )
    token = token.join(halves, [*_ROW, "line_no", "word"], "left_anti").select(*_ROW, "line_no", "word")
    whole = hyphens.select(*_ROW, "line_no", "next_key", "next_line", "left_piece", F.col("joined").alias("word"))
    corrections = staged(misread_words(token.select("word").unionByName(whole.select("word")), words), "corrections")
    single = token.join(corrections, "word").select(*_ROW, "line_no", "word", "correction")
    second = F.col("correction").startswith(F.col("left_piece"))
    torn = whole.join(corrections, "word").select(
        "tbl", F.when(second, F.col("next_key")).otherwise(F.col("row_key")).alias("row_key"), F.when(second, F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"), "word", "correction"
    )
    return Findings(furniture, hyphens, links, single.unionByName(torn.select(*_ROW, "line_no", "word", "correction")).unionByName(numbers).distinct())


def marked_lines(f: Findings) -> DataFrame:
    """tbl, row_key, line_no, kind: furniture, hyphen and misread lines, each kind once a line."""
    parts = [(f.furniture, "furniture"), (f.hyphens, "hyphen"), (f.misread, "misread")]
    frames = [df.select("tbl", "row_key", "line_no", F.lit(kind).alias("kind")) for df, kind in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).distinct()


_ITEM = re.compile(r"[•*–—-]\s|\(?[a-zA-Z\d০-৯०-९]{1,3}[.)]\s|[\d০-৯०-९]+(?:\.[\d০-৯०-৯]+)+\s|[A-E]\s")
_ROW_OF_VALUES = re.compile(r"\S\s{3,}\d+(?:[.,]\d+)?\s*$|\t")


def _replaced(text: str, wrong: str, right: str, count: int = 0) -> tuple[str, int]:
    """The text with a misread word corrected in the case it is written in, and how often it stood there."""
    shape = lambda m: right.upper() if m[0].isupper() and len(m[0]) > 1 else right.capitalize() if m[0][:1].isupper() else right
    return re.subn(f"(?<![\\w\\u0900-\\u09ff]){re.escape(wrong)}(?![\\w\\u0900-\\u09ff])", shape, text, count=count, flags=re.I)


def _rebuild(text: str, gone: set[int], joins: list[tuple[int, int, str, bool]], fixes: dict[int, list[tuple[str, str]]]) -> str:
    """The text as paragraphs, without furniture, with broken words joined and misread words replaced."""
    lines = text.split("\n")
    glued: set[int] = set()
    for line_no, next_line, left, broken in joins:
        line = lines[line_no - 1]
        if not broken:
            lines[line_no - 1] = line.rstrip().rstrip(HYPHENS) + "-"
            glued.add(line_no)
        elif next_line == line_no:
            lines[line_no - 1] = re.sub(f"({re.escape(left)})[{HYPHENS}] ", "\\1", line, count=1, flags=re.I)
        else:
            lines[line_no - 1] = line.rstrip().rstrip(HYPHENS)
            glued.add(line_no)
    torn: dict[int, list[tuple[str, str]]] = {}
    for i, found in fixes.items():
        for wrong, right in found:
            lines[i - 1], n = _replaced(lines[i - 1], wrong, right)
            if not n:  # the word stands on two lines and is whole only in its paragraph
                torn.setdefault(i, []).append((wrong, right))
    kept = [(i, re.sub(r"[ \t]{2,}", " ", x.strip()), bool(_ROW_OF_VALUES.search(x))) for i, x in enumerate(lines, 1) if i not in gone]
    lengths = sorted(len(x) for _, x, _ in kept if x)
    width = lengths[int(0.8 * (len(lengths) - 1))] if lengths else 0
    paragraphs: list[tuple[str, list[int]]] = []
    carry, tight, ended = "", False, False
    held: list[int] = []
    for k, (i, bare, row) in enumerate(kept):
        if (not bare or row or ended or _ITEM.match(bare)) and not tight:
            paragraphs.append((carry, held))
            carry, held = bare, []
        else:
            carry = carry + ("" if tight or not carry else " ") + bare
        held.append(i)
        tight = i in glued
        # a line that left room for the next word was ended by its author: a heading, a row of values, the end of a paragraph
        after = kept[k + 1][1] if k + 1 < len(kept) else ""
        room = len(bare) + 1 + len(after.split(" ")[0]) <= width
        starts = after[:1].isupper() or after[:1].isdigit() or bool(_INDIC.match(after[:1]))
        ended = row or (room and (starts or bool(_STOP.search(bare))))
    paragraphs.append((carry, held))
    out = []
    for body, numbers in paragraphs:
        for wrong, right in [f for i in numbers for f in torn.get(i, ())]:
            body, _ = _replaced(body, wrong, right, 1)
        out.append(body)
    return "\n\n".join(p for p in out if p)


def repaired(texts: DataFrame, f: Findings) -> DataFrame:
    """tbl, row_key, text: every text of texts rebuilt from its findings; null and empty texts stay as they are.

    A word broken over two pages keeps its hyphen at the end of the first: every page stays a text of its own."""
    gone = f.furniture.groupBy(*_ROW).agg(F.collect_set("line_no").alias("gone"))
    pairs = f.hyphens.unionByName(f.links).where("next_key = row_key")
    joins = pairs.groupBy(*_ROW).agg(F.sort_array(F.collect_set(F.struct("line_no", "next_line", "left_piece", "broken"))).alias("joins"))
    fixes = f.misread.groupBy(*_ROW).agg(F.sort_array(F.collect_set(F.struct("line_no", "word", "correction"))).alias("fixes"))
    src = texts.where("row_key is not null").select(*_ROW, "text").dropDuplicates(_ROW)
    src = src.join(gone, _ROW, "left").join(joins, _ROW, "left").join(fixes, _ROW, "left")

    def run(batches):
        for b in batches:
            out = []
            for text, g, j, x in zip(*(b.column(k).to_pylist() for k in ("text", "gone", "joins", "fixes"))):
                if not text:
                    out.append(text)
                    continue
                fix: dict[int, list] = {}
                for e in x or ():
                    fix.setdefault(e["line_no"], []).append((e["word"], e["correction"]))
                rows = [(e["line_no"], e["next_line"], e["left_piece"], e["broken"]) for e in j or ()]
                out.append(_rebuild(text, set(g or ()), rows, fix))
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("row_key"), pa.array(out, pa.string())], names=["tbl", "row_key", "text"])

    return src.mapInArrow(run, "tbl string, row_key string, text string")


def scanned_texts(ocr_pages: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """tbl, row_key, doc, page, text of the three tables that hold scanned text."""
    parts = [(ocr_pages, "ocr_pages", "page_id", "page_number", "text"), (chunks, "chunks", "chunk_id", "page_number", "text_raw"), (questions, "parsed_questions", "question_id", "page_number", "text_raw")]
    out = None
    for df, name, key, page, text in parts:
        one = df.select(
            F.lit(name).alias("tbl"),
            F.col(key).cast("string").alias("row_key"),
            F.col("source_document_id").cast("string").alias("doc"),
            F.col(page).cast("int").alias("page"),
            F.col(text).cast("string").alias("text"),
        )
        out = one if out is None else out.unionByName(one)
    return out
