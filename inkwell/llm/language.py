"""Missing or wrong language labels, and languages mixed inside a text (problem 3).

Word-first backoff: a known word scores by its log frequency in each language; a word never
seen is scored by the longest of its character n-grams that are known, down to single characters.
Each sentence takes the language with the best sum, a text the one that holds most of its letters.

The classifier is fitted on a bounded sample of labelled rows (`sample_rows` per label). Labels
are partly wrong, so the sample is labelled sentence by sentence with a first fit and fitted again. A word that the
sample doesn't hold is taken for a word of a language where most of its n-grams are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.printform import print_form
from inkwell.operators.samples import hash_cut
from inkwell.session import staged

LANGUAGES = ("en", "bn", "fr", "es", "hi")

_ODD = re.compile("[ ­̀-ͯͰ-ӿ -‏ -⁤℀-⅏ﬀ-ﬆ﻿！-￮]")
_LINK = re.compile(r"</?a\b[^>]*>|\b(?:https?://|www\.)\S+")
_WORD = re.compile("[^\\W\\d_ऀ-৿]{2,}|[ऀ-ॣॱ-ॿ]{2,}|[ঀ-ৣৰ৾]{2,}")
_CUT = re.compile(
    "(?<=[.!?।॥])[\"”’»)\\]]*\\s+"  # after a sentence
    "|\\n\\s*\\n\\s*"  # between paragraphs
    "|\\s*(?:[.…_]{3,}\\s*)+"  # at leaders and ruled space
    "|\\n(?=[ \\t]*(?:[•*·–—-]|\\(?[a-z\\d०-९০-৯]{1,3}[.)]|[\\d०-९০-৯]+(?:\\.[\\d०-९০-৯]+)*[ \\t]|[A-E][ .)]))"  # before a list item
)
_END = re.compile("(?<![.\\s])[.!?।॥][\"”’»)\\]]*\\s*$")
_GRAM = 4
MIN_SENTENCE_WORDS = 3
MIN_KNOWN_SHARE = 0.6  # share of a sentence's words that are known, or look like words, for it to be a whole sentence
MIN_KNOWN_GRAMS = 0.5  # share of an unseen word's longest n-grams that are known, for it to look like a word


def clean(text: str) -> str:
    """The text without links, in print form where it holds odd characters."""
    if _ODD.search(text):
        text = print_form(text)
    if "http" in text or "www." in text or "<a" in text:
        text = _LINK.sub(" ", text)
    return text


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the sentences, headings and list items of a text."""
    at = 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


class WordModel:
    """Log frequencies of words and, for words never seen, of character n-grams."""

    def __init__(self, words: list[str], counts: np.ndarray, smoothing: float = 0.5, remember: int = 2_000_000):
        self.remember = remember  # unseen words a worker keeps the scores of
        total = counts.sum(0) + smoothing * max(1, len(words))
        self.index = {w: i for i, w in enumerate(words)}
        self.rows = [tuple(r) for r in np.log((counts + smoothing) / total)] if len(words) else []
        grams: dict[str, np.ndarray] = {}
        for w, c in zip(words, counts):
            for n in range(1, _GRAM + 1):
                for g in self._grams(w, n):
                    if g in grams:
                        grams[g] += c
                    else:
                        grams[g] = c.astype(float).copy()
        size = np.ones((_GRAM + 1, len(LANGUAGES)))
        for g, c in grams.items():
            size[len(g)] += c
        kinds = np.bincount([len(g) for g in grams], minlength=_GRAM + 1) if grams else np.ones(_GRAM + 1)
        self.grams = {g: np.log((c + smoothing) / (size[len(g)] + smoothing * kinds[len(g)])) for g, c in grams.items()}
        # scores and, in the last column, whether it is known or looks like a word; room grows by doubling
        self.table = np.ones((len(self.rows), len(LANGUAGES) + 1))
        self.table[:, :-1] = np.array(self.rows or np.zeros((0, len(LANGUAGES))))
        self.filled = len(self.rows)

    @staticmethod
    def _grams(word: str, n: int) -> list[str]:
        w = f"^{word}$" if n > 1 else word
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    def _unseen(self, word: str) -> np.ndarray:
        for n in range(_GRAM, 0, -1):
            known = [self.grams[g] for g in self._grams(word, n) if g in self.grams]
            if known:
                return sum(known) / len(known)
        return np.zeros(len(LANGUAGES))

    def _looks_known(self, word: str) -> bool:
        grams = self._grams(word, min(_GRAM, len(word)))
        return sum(g in self.grams for g in grams) >= MIN_KNOWN_GRAMS * len(grams)

    def _add(self, word: str) -> int:
        if self.filled == len(self.table):
            self.table = np.vstack([self.table, np.empty((max(1024, len(self.table)), self.table.shape[1]))])
        i = self.filled
        self.table[i, :-1] = self._unseen(word)
        self.table[i, -1] = self._looks_known(word)
        self.filled += 1
        self.index[word] = i
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the words in the table of scores; what was unseen is added to it for the batches to come."""
        if self.filled - len(self.rows) > self.remember:  # forget, so that a worker's memory stays bounded
            self.filled = len(self.rows)
            self.index = {w: i for w, i in self.index.items() if i < self.filled}
        get = self.index.get
        return np.array([self._add(w) if (i := get(w)) is None else i for w in words], np.int64)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids, :-1]

    def known(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids, -1]


def read_batch(texts: list[str | None], model: WordModel):
    """For each text its sentences as (start, end, language, posterior, letters, whole).

    whole: the sentence is ended, has a few words, and most of them are known; a notice, a mirrored line or the end
    of a sentence that the layout tore apart is no whole sentence.
    """
    marks: list[tuple] = []
    words: list[str] = []
    owners: list[int] = []
    for t, raw in enumerate(texts):
        if not raw:
            continue
        text = clean(raw)
        for a, b in sentences(text):
            found = _WORD.findall(text[a:b].lower())
            if not found or (len(found) < 3 and all(len(w) < 4 and w < "\u0900" for w in found)):
                continue  # nothing, or units and symbols
            whole = len(found) >= MIN_SENTENCE_WORDS and _END.search(text, max(a, b - 8), b) is not None
            marks.append((t, a, b, sum(map(len, found)), whole))
            owners.append(len(words))
            words += found
    out: list[list[tuple]] = [[] for _ in texts]
    if not marks:
        return out
    ids, starts = model.ids(words), np.array(owners)
    total = np.add.reduceat(model.scores(ids), starts, axis=0)
    known = np.add.reduceat(model.known(ids), starts) / np.diff([*owners, len(words)])
    best = total.argmax(1)
    post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    for (t, a, b, letters, whole), k, p, share in zip(marks, best, post, known):
        out[t].append((a, b, LANGUAGES[k], float(p), letters, whole and share >= MIN_KNOWN_SHARE))
    return out


def _main(parts: list[tuple]) -> tuple[str | None, float]:
    if not parts:
        return None, 0.0
    weight = dict.fromkeys(LANGUAGES, 0.0)
    sure = dict.fromkeys(LANGUAGES, 0.0)
    for _, _, lang, p, letters, _ in parts:
        weight[lang] += letters
        sure[lang] += letters * p
    lang = max(LANGUAGES, key=lambda x: weight[x])
    return lang, sure[lang] / sum(weight.values())


def _passages(parts: list[tuple]) -> list[dict]:
    """Runs of sentences in one language."""
    runs: list[dict] = []
    for a, b, lang, p, letters, _ in parts:
        if runs and runs[-1]["lang"] == lang:
            last = runs[-1]
            last["confidence"] = (last["confidence"] * last["letters"] + p * letters) / (last["letters"] + letters)
            last["end"], last["letters"] = b, last["letters"] + letters
        else:
            runs.append({"lang": lang, "start": a, "end": b, "letters": letters, "confidence": p})
    return runs


_RESULT = (
    "row_key string, label string, owner string, main string, confidence double, whole array<string>, "
    "passages array<struct<lang:string,start:int,end:int,letters:int,confidence:double>>"
)
_PASSAGE = pa.list_(
    pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("letters", pa.int32()), ("confidence", pa.float64())])
)


def declared(label: Column) -> Column:
    """The language a label names, whatever its case, region suffix or surrounding blanks; null for none or unknown."""
    bare = F.regexp_extract(F.lower(F.regexp_replace(label, "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")), "^([^-_]*)", 1)
    return F.when(bare.isin("", "unknown", "und"), None).otherwise(bare)


def fit(df: DataFrame, text: str, label: str, *, sample_rows: int = 3_000, seed: int = 11, refits: int = 1) -> WordModel:
    """Fit on at most sample_rows rows per language, taken by a seeded hash of the text.

    Words of the sample are counted by Spark; the model holds the sample's words, so its size is bounded by it.
    Rows with a null text or a label that names none of LANGUAGES are left out; with no labelled row at all the
    model knows no word and every text has no language.
    """
    rows = df.select(F.col(f"`{text}`").alias("t"), declared(F.col(f"`{label}`")).alias("l")).where("t is not null")
    sizes = {r.l: r.n for r in rows.where(F.col("l").isin(*LANGUAGES)).groupBy("l").agg(F.count("*").alias("n")).collect()}
    # what the cut lets through is a little more than the sample, whatever the size of the table; copies of a text are one row
    cut = F.lit(None).cast("long")
    for lang, n in sizes.items():
        cut = F.when(F.col("l") == lang, F.lit(hash_cut(sample_rows, n))).otherwise(cut)
    few = rows.withColumn("h", F.xxhash64(F.lit(seed), "t")).where(F.col("h") <= cut)
    few = few.groupBy("l", "h").agg(F.min("t").alias("t")).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h")))
    picked = staged(few.where(F.col("r") <= sample_rows).select("t", "l").repartition(df.sparkSession.sparkContext.defaultParallelism), "sample")
    model = None
    for _ in range(refits + 1):
        held = df.sparkSession.sparkContext.broadcast(model)

        def count(batches, held=held):
            got: dict[tuple[str, str], int] = {}
            for b in batches:
                for t, lang in zip(*(c.to_pylist() for c in b.columns)):
                    body = clean(t)
                    if held.value is None:
                        for w in _WORD.findall(body.lower()):
                            got[w, lang] = got.get((w, lang), 0) + 1
                    else:
                        for a, z, own, p, _, _ in read_batch([t], held.value)[0]:
                            for w in _WORD.findall(body[a:z].lower()) if p > 0.9 else ():
                                got[w, own] = got.get((w, own), 0) + 1
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in got]), pa.array([k[1] for k in got]), pa.array(list(got.values()), pa.int64())], names=["w", "l", "n"]
                )

        counts = picked.mapInArrow(count, "w string, l string, n long").groupBy("w", "l").agg(F.sum("n").alias("n")).toPandas()
        if not len(counts):
            return WordModel([], np.zeros((0, len(LANGUAGES))))
        wide = counts.pivot(index="w", columns="l", values="n").reindex(columns=list(LANGUAGES)).fillna(0.0)
        model = WordModel(list(wide.index), wide.to_numpy(float))
    return model


def label_texts(df: DataFrame, key: str, text: str, label: str, model: WordModel, owner: str | None = None) -> DataFrame:
    """row_key, label, owner, main, confidence, whole, passages for every row with a key.

    main: the language that holds most of the text's letters, null for a text without words in a language (null,
    empty, or only numbers, formulas, links and option letters). confidence: the posterior-weighted share of that
    language. whole: the languages in which the text has at least one whole sentence. passages: runs of sentences in
    one language, with offsets into clean(text). Repeated rows give repeated results; ties go to the order of LANGUAGES.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = read_batch(b.column(3).to_pylist(), held.value)
            mains = [_main(parts) for parts in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    b.column(2),
                    pa.array([m for m, _ in mains], pa.string()),
                    pa.array([c for _, c in mains], pa.float64()),
                    pa.array([sorted({x[2] for x in parts if x[5]}) for parts in got], pa.list_(pa.string())),
                    pa.array([_passages(parts) for parts in got], _PASSAGE),
                ],
                names=["row_key", "label", "owner", "main", "confidence", "whole", "passages"],
            )

    src = df.select(
        F.col(f"`{key}`").cast("string").alias("row_key"),
        F.col(f"`{label}`").cast("string").alias("label"),
        (F.col(f"`{owner}`") if owner else F.lit(None)).cast("string").alias("owner"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).where("row_key is not null")
    return src.mapInArrow(run, _RESULT)


def wrong_labels(labelled: DataFrame) -> DataFrame:
    """row_key, lang of rows whose label is missing or names another language than the main one."""
    own = declared(F.col("label"))
    return labelled.where(F.col("main").isNotNull() & (own.isNull() | (own != F.col("main")))).select("row_key", F.col("main").alias("lang"))


def mixed_languages(labelled: DataFrame) -> DataFrame:
    """row_key, lang: one row for each language of a text with whole sentences in two or more."""
    return labelled.where(F.size("whole") > 1).select("row_key", F.explode("whole").alias("lang"))


def owner_languages(labelled: DataFrame) -> DataFrame:
    """owner, main, confidence: the language of most of an owner's distinct rows; a tie goes to the larger summed confidence, then by name."""
    each = labelled.where("owner is not null and main is not null")
    votes = each.groupBy("owner", "main").agg(F.count("*").alias("n"), F.sum("confidence").alias("sure"))
    best = F.max(F.struct("n", "sure", F.col("main").alias("lang"))).alias("best")
    return votes.groupBy("owner").agg(best, F.sum("n").alias("all")).select(
        "owner", F.col("best.lang").alias("main"), (F.col("best.sure") / F.col("all")).alias("confidence")
    )


def labelled_tables(documents: DataFrame, chunks: DataFrame, *, sample_rows: int = 3_000) -> tuple[DataFrame, DataFrame]:
    """label_texts of documents and of the distinct chunks, by a model fitted on documents."""
    model = fit(documents, "text", "lang", sample_rows=sample_rows)
    docs = label_texts(documents, "doc_id", "text", "lang", model)
    own = label_texts(chunks, "chunk_id", "text", "language", model, "source_document_id")
    return docs, own.dropDuplicates(["row_key"])


def all_labels(documents: DataFrame, chunks: DataFrame, sources: DataFrame, *, sample_rows: int = 3_000) -> DataFrame:
    """tbl, row_key, label, main, confidence of every text and source document; null main where nothing is written in a language."""
    docs, own = (staged(x.drop("passages"), "labels") for x in labelled_tables(documents, chunks, sample_rows=sample_rows))
    src = sources.select(F.col("source_document_id").alias("row_key"), F.col("declared_language").alias("label")).where("row_key is not null")
    of = src.join(owner_languages(own).withColumnRenamed("owner", "row_key"), "row_key", "left")
    parts = [x.select(F.lit(name).alias("tbl"), "row_key", "label", "main", "confidence") for name, x in (("documents", docs), ("chunks", own), ("source_documents", of))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def all_passages(documents: DataFrame, chunks: DataFrame, *, sample_rows: int = 3_000) -> DataFrame:
    """tbl, row_key, place, lang, start, end, letters, confidence: the runs of sentences in one language of every text, with
    offsets into clean(text); texts that hold no language have no row."""
    out = None
    for name, labelled in zip(("documents", "chunks"), labelled_tables(documents, chunks, sample_rows=sample_rows)):
        rows = labelled.select(F.lit(name).alias("tbl"), "row_key", F.posexplode("passages").alias("place", "p"))
        rows = rows.select("tbl", "row_key", "place", "p.lang", "p.start", "p.end", "p.letters", "p.confidence")
        out = rows if out is None else out.unionByName(rows)
    return out


def language_report(documents: DataFrame, chunks: DataFrame, sources: DataFrame, *, sample_rows: int = 3_000) -> DataFrame:
    """tbl, row_key, kind, lang: every wrong or missing label (main) and every language of a mixed text (segment)."""
    docs, own = (staged(x.drop("passages"), "labels") for x in labelled_tables(documents, chunks, sample_rows=sample_rows))
    parts = []
    for name, labelled in (("documents", docs), ("chunks", own)):
        for kind, found in (("main", wrong_labels(labelled)), ("segment", mixed_languages(labelled))):
            parts.append(found.select(F.lit(name).alias("tbl"), "row_key", F.lit(kind).alias("kind"), "lang"))
    src = sources.select(F.col("source_document_id").alias("row_key"), F.col("declared_language").alias("label")).where("row_key is not null")
    of = src.join(owner_languages(own).withColumnRenamed("owner", "row_key"), "row_key")
    parts.append(wrong_labels(of).select(F.lit("source_documents").alias("tbl"), "row_key", F.lit("main").alias("kind"), "lang"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
