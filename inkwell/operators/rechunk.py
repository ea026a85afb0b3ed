"""Re-chunking: long texts into overlapping windows of whole sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """Sizes in estimated tokens; a last piece under `stub` is evened out with the one before it."""

    most: int = 600
    overlap: int = 50
    stub: int = 150


class Piece(NamedTuple):
    text: str
    tokens: int
    carried: int  # words taken over from the piece before
    start: int  # where the piece's own text stands in the stripped text
    end: int


# Where a text falls into blocks and sentences, and the script whose tokens are estimated by length.
_BLOCK = re.compile(r"\n\s*\n|\n(?=•\s)")
_STOP = re.compile(r"(?<=[.!?।])[\"')\]]*\s+")
_BENGALI = re.compile("[ঀ-৿]")


class _Size(NamedTuple):
    """What a token estimate needs to know of a text; sizes of texts that are joined by a blank add up."""

    words: int = 0
    chars: int = 0
    bengali: int = 0

    @staticmethod
    def of(text: str) -> _Size:
        return _Size(len(text.split()), len(text), len(_BENGALI.findall(text)))

    def __add__(self, other: _Size) -> _Size:  # type: ignore[override]
        if not self.chars or not other.chars:
            return self if self.chars else other
        return _Size(self.words + other.words, self.chars + 1 + other.chars, self.bengali + other.bengali)

    def tokens(self, language: str | None) -> int:
        if not self.chars:
            return 0
        return max(1, self.chars // 3 if language == "bn" or self.bengali > 0.3 * self.chars else self.words)


class _Unit(NamedTuple):
    """A sentence, or a part of one that is longer than a window, with its place in the text."""

    text: str
    start: int
    end: int
    size: _Size


def _pieces_between(pattern: re.Pattern, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Places of what stands between the matches of a pattern in text[lo:hi], without outer white space and empty parts."""
    ends = [m.span() for m in pattern.finditer(text[lo:hi])]
    for a, b in zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), hi - lo]):
        part = text[lo + a : lo + b]
        if part.strip():
            at = lo + a + len(part) - len(part.lstrip())
            yield at, at + len(part.strip())


def _units(text: str, language: str | None, w: Window) -> list[_Unit]:
    out = []
    for lo, hi in _pieces_between(_BLOCK, text, 0, len(text)):
        for a, b in _pieces_between(_STOP, text, lo, hi):
            size = _Size.of(text[a:b])
            if size.tokens(language) <= w.most:
                out.append(_Unit(text[a:b], a, b, size))
                continue
            held: list[re.Match] = []
            size = _Size()
            for m in re.finditer(r"\S+", text[a:b]):
                held.append(m)
                size = size + _Size.of(m[0])
                if size.tokens(language) >= w.most - w.overlap:  # so that the overlap still fits before it
                    out.append(_Unit(" ".join(x[0] for x in held), a + held[0].start(), a + m.end(), size))
                    held, size = [], _Size()
            if held:
                out.append(_Unit(" ".join(x[0] for x in held), a + held[0].start(), a + held[-1].end(), size))
    return out


def _last_words(words: list[str], language: str | None, most: int, before: _Size = _Size()) -> str:
    """As many of the last words as fit in `most` tokens together with a text of size `before` behind them."""
    size, k = before, len(words)
    while k and (bigger := _Size.of(words[k - 1]) + size).tokens(language) <= most:
        size, k = bigger, k - 1
    return " ".join(words[k:])


def _overlap(body: str, language: str | None, w: Window) -> str:
    """The last whole sentences of a body that fit in the overlap, or else the last words of its last one."""
    if w.overlap <= 0:
        return ""
    sentences = [body[a:b] for a, b in _pieces_between(_STOP, body, 0, len(body))]
    size, k = _Size(), len(sentences)
    while k and ((bigger := _Size.of(sentences[k - 1]) + size).tokens(language) <= w.overlap or k == len(sentences)):
        size, k = bigger, k - 1
    tail = " ".join(sentences[k:])
    return tail if size.tokens(language) <= w.overlap else _last_words(tail.split(), language, w.overlap)


def _piece(units: list[_Unit], before: str, language: str | None, w: Window) -> Piece:
    """The piece of some units behind what is carried over, of which as much is left as fits."""
    body = " ".join(u.text for u in units)
    size = _Size.of(body)
    if before and (_Size.of(before) + size).tokens(language) > w.most:
        before = _last_words(before.split(), language, w.most, size)
    text = f"{before} {body}" if before else body
    return Piece(text, (_Size.of(before) + size).tokens(language), len(before.split()), units[0].start, units[-1].end)


def _evened(groups: list[list[_Unit]], language: str | None, w: Window) -> tuple[list[list[_Unit]], bool]:
    """The groups with the last two made one, if that fits a window, or cut in halves; and whether they were changed."""
    both = groups[-2] + groups[-1]
    size = sum((u.size for u in both), _Size())
    if size.tokens(language) <= w.most:
        return [*groups[:-2], both], True
    half, k, head = size.tokens(language) // 2, 1, both[0].size
    while k < len(both) and (head + both[k].size).tokens(language) <= half:
        head, k = head + both[k].size, k + 1
    return ([*groups[:-2], both[:k], both[k:]], True) if k < len(both) else (groups, False)


def windows(text: str | None, language: str | None = None, w: Window = Window()) -> list[Piece]:
    """The pieces of a text: one untouched piece where it fits a window, none for a blank one.

    Units are taken as long as they fit behind what the piece before hands over: its last whole sentences within the
    overlap, or the last words of one. No piece exceeds `most`. Pieces that were evened out start without an overlap,
    but for the second half, which takes over the end of the first where it fits.
    """
    text = (text or "").strip()
    if not text:
        return []
    if (whole := _Size.of(text).tokens(language)) <= w.most:
        return [Piece(text, whole, 0, 0, len(text))]
    groups: list[list[_Unit]] = []
    handed: list[str] = []
    now: list[_Unit] = []
    before, size = "", _Size()
    for unit in _units(text, language, w):
        if now and (size + unit.size).tokens(language) > w.most:
            groups.append(now)
            handed.append(before)
            before = _overlap(" ".join(u.text for u in now), language, w)
            now, size = [], _Size.of(before)
        now.append(unit)
        size = size + unit.size
    groups.append(now)
    handed.append(before)
    out = [_piece(g, b, language, w) for g, b in zip(groups, handed)]
    if len(out) > 1 and out[-1].tokens < w.stub:
        evened, changed = _evened(groups, language, w)
        if changed:
            kept = out[:-2]
            first = _piece(evened[len(kept)], "", language, w)
            out = [*kept, first]
            if len(evened) > len(kept) + 1:
                rest = evened[-1]
                tail = _overlap(first.text, language, w)
                fits = (_Size.of(tail) + sum((u.size for u in rest), _Size())).tokens(language) <= w.most
                out.append(_piece(rest, tail if fits else "", language, w))
    return out


def rechunk(df: DataFrame, key: str, text: str, language: str, w: Window = Window()) -> DataFrame:
    """key, ordinal, text, tokens, carried_words, char_start, char_end: the windows of every text, in one pass without a shuffle.

    The offsets are those of the piece's own text, without what it takes over, in the stripped text. Blank and null texts give no piece; rows with a null key are left out; repeated rows give repeated pieces.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{language}`").cast("string").alias("lang"))

    names = ["ordinal", "text", "tokens", "carried_words", "char_start", "char_end"]

    def run(batches):
        for b in batches:
            take, pieces = [], []
            for i, (t, lang) in enumerate(zip(b.column("text").to_pylist(), b.column("lang").to_pylist())):
                for n, p in enumerate(windows(t, lang, w)):
                    take.append(i)
                    pieces.append((n, *p))
            columns = list(zip(*pieces)) or [()] * len(names)
            cols = [pa.array(c, pa.string() if n == "text" else pa.int32()) for n, c in zip(names, columns)]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(take, pa.int64())), *cols], names=["key", *names])

    schema = src.select("key", *[F.col("text") if n == "text" else F.lit(0).alias(n) for n in names]).schema
    return src.where("key is not null").mapInArrow(run, schema)
