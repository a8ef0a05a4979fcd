"""Problem 3: splitting oversized items at natural boundaries, with balanced targets."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT = 3_000
OVERLAP = 200
#: A target may move by this share of a piece to reach a boundary.
REACH = 0.3

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_PARAGRAPH = re.compile(r"(?:\r\n|[\n\r\x85\u2028])(?:[ \t]*(?:\r\n|[\n\r\x85\u2028]))+|\u2029")
_SENTENCE = re.compile(r"[.!?\u2026]+[\"'\u00bb\u201d\u2019)\]]*\s+|[\u3002\uff01\uff1f]+[\u300d\u300f\u201d]*")
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"[,;}\])>]+")

PARAGRAPH, LINE, SENTENCE, WORD, MARK, NONE = 5, 4, 3, 2, 1, 0
_NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", MARK: "mark", NONE: "none"}


def boundaries(text: str) -> dict[int, list[int]]:
    """Ascending offsets, by strength, at which a new paragraph, line, sentence or word begins, or what follows a mark in data without blanks."""
    return {s: [m.end() for m in r.finditer(text)] for s, r in ((PARAGRAPH, _PARAGRAPH), (LINE, _LINE), (SENTENCE, _SENTENCE), (WORD, _SPACE), (MARK, _MARK))}


def _nearest(places: list[int], target: float, lo: int, hi: int) -> int | None:
    """The place between ``lo`` and ``hi`` that is nearest to ``target``."""
    i = bisect_left(places, min(max(target, lo), hi))
    near = [places[j] for j in (i - 1, i) if 0 <= j < len(places) and lo <= places[j] <= hi]
    return min(near, key=lambda p: (abs(p - target), p)) if near else None


def _hard(text: str, at: int, lo: int) -> int:
    """A cut near ``at`` that splits neither a line end of two characters nor a letter from its marks."""
    back = at
    while back > lo and (text[back - 1 : back + 1] == "\r\n" or unicodedata.combining(text[back]) or text[back] in "\u200d\ufe0f" or text[back - 1] == "\u200d"):
        back -= 1
    return back if back > lo else at


def _snapped(text: str, where: dict[int, list[int]], target: float, lo: int, hi: int, reach: float) -> tuple[int, int]:
    """(offset, strength): the strongest boundary within ``reach`` of the target, the nearest of its kind; if there is none any other between ``lo`` and ``hi``, before a word is split."""
    near_lo, near_hi = max(lo, int(target - reach)), min(hi, int(target + reach))
    for kinds, a, b in (((PARAGRAPH, LINE, SENTENCE), near_lo, near_hi), ((SENTENCE, LINE, PARAGRAPH, WORD, MARK), lo, hi)):
        for strength in kinds:
            if (p := _nearest(where[strength], target, a, b)) is not None:
                return p, strength
    return _hard(text, min(max(int(target), lo), hi), lo), NONE


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of each piece of ``text``; boundary says what kind of place the piece ends at.

    At most ``limit`` characters a piece; each after the first starts ``overlap`` characters before
    the end of the one before. A text within the limit is one piece. The least number of pieces sets targets at equal distances and each is moved to the strongest boundary near it;
    where what is left no longer fits into the pieces that are left, a piece is added and the targets to come are balanced anew. The time is in proportion to the text and the number of its boundaries.
    """
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must exceed the overlap")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    where, fresh, end = boundaries(text), limit - overlap, len(text)
    cuts, last, left = [], overlap, -(-(end - overlap) // fresh)
    while (left := max(left, -(-(end - last) // fresh))) > 1:
        step = (end - last) / left
        cuts.append(_snapped(text, where, last + step, last + 1, min(last + fresh, end - 1), REACH * (step + overlap)))
        last, left = cuts[-1][0], left - 1
    starts = [0, *(c - overlap for c, _ in cuts)]
    return [(a, b, "end" if b == end else _NAMES[s]) for a, (b, s) in zip(starts, [*cuts, (end, PARAGRAPH)], strict=True)]


def first_line(lineno, line_end, lines: int) -> int | None:
    """The line a text starts at: the smaller of its numbers, reckoned from the last if the first is missing, None if both are."""
    known = [int(x) for x in (lineno, line_end) if x is not None and x == x]
    if lineno is not None and lineno == lineno:
        return max(1, min(known))
    return max(1, known[0] - lines + 1) if known else None


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                ends = [m.end() for m in _LINE.finditer(r.text)]
                base = first_line(r.lineno, r.line_end, len(ends) + (not ends or ends[-1] < len(r.text)))
                parts = split_text(r.text, limit, overlap)
                line = lambda p, base=base, ends=ends: None if base is None else base + bisect_right(ends, p)
                rows += [(r.id, r.content_sha, i, len(parts), a, b, line(a), line(max(a, b - 1)), kind, r.text[a:b]) for i, (a, b, kind) in enumerate(parts, 1)]
            out = pd.DataFrame(rows, columns=["id", "content_sha", "piece_no", "pieces", "char_start", "char_end", "line_start", "line_end", "boundary", "text"])
            out[["line_start", "line_end"]] = out[["line_start", "line_end"]].astype("Int32")
            yield out

    return run


PIECES = "id string, content_sha string, piece_no int, pieces int, char_start int, char_end int, line_start int, line_end int, boundary string, text string"


def split_units(units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every distinct (id, content_sha) whose text has more than ``limit`` characters (code points).

    Offsets count characters, ``char_end`` is exclusive; dropping the first ``overlap`` characters of all pieces but the first and
    joining them gives the text back. Line ranges count the line ends that the text really has from its first line (see
    ``first_line``); they are null where both numbers are. Null and short texts give no row, repeated
    rows count once (the greatest text and then line numbers if they differ), other columns are ignored.
    Only oversized rows leave the JVM; each text is cut by itself, in time proportional to its length.
    """
    large = units.where(F.length("text") > limit).groupBy("id", "content_sha").agg(F.max(F.struct("text", "lineno", "line_end")).alias("r"))
    return large.select("id", "content_sha", "r.*").mapInPandas(_pieces(limit, overlap), PIECES)
