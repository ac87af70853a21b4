"""License scan: exact base phrases, and bounded-error search for short notices.

A text is lower-cased (A-Z) and reduced to its words joined by single spaces.  A notice with
``e`` allowed errors is cut into ``e + 1`` pieces: by the pigeonhole principle every occurrence
with at most ``e`` edits holds one piece exactly, so plain substring search for the pieces finds
every candidate place, and where an occurrence may start there; at each such start the ``regex`` library's bounded-error matching then
tells whether there is one, and edit distances from there give all
spans within the errors that hold the core words.  A start is looked at through a window of the notice's length, and equal windows once, so
work is in proportion to a text's places, however close they lie.  Of those, hits are taken by fewest edits, then
leftmost, that overlap no hit of the notice taken before: every occurrence is a hit or overlaps one
with no more edits.

Defined edge cases: null is the empty text; texts without words give zero counts, null
positions and empty labels; overlapping base places all count; repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of the method's own: phrase -> (label, errors allowed, words that must stand in the span unchanged).
NOTICES = {
    "released under the mit license": ("mit", 3, ("mit",)),
    "under the mit license": ("mit", 2, ("mit",)),
    "licensed under the apache license version 2": ("apache-2", 4, ("2",)),
    "apache license version 2": ("apache-2", 2, ("2",)),
    "licensed under cc by nc": ("cc-by-nc", 2, ("cc", "by", "nc")),
    "gnu general public license": ("gpl", 2, ()),
    "gnu lesser general public license": ("lgpl", 2, ("lesser",)),
    "mozilla public license": ("mpl", 2, ()),
    "creative commons attribution": ("cc-by", 2, ()),
    "redistribution and use in source and binary forms": ("bsd", 4, ()),
}
_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Windows whose occurrences are kept.
KNOWN = 65_536
_EDGE = regex.compile(r"\b")


@dataclass(frozen=True)
class Hit:
    """A verified span of words of the text: label, first and last word, edits, share of the phrase without edits."""

    label: str
    first: int
    last: int
    edits: int
    score: float


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces of nearly equal length, with their offsets."""
    n, k = len(phrase), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(cuts[i], phrase[cuts[i] : cuts[i + 1]]) for i in range(k)]


def ends(phrase: str, errors: int, text: str, start: int) -> dict[int, int]:
    """End -> edit distance of ``phrase`` and text[start:end], for every end within ``errors`` edits."""
    far, n = errors + 1, len(text) - start
    row = {j: j for j in range(min(errors, n) + 1)}
    for i, ch in enumerate(phrase, 1):
        new: dict[int, int] = {}
        left = far
        for j in range(max(0, i - errors), min(n, i + errors) + 1):
            cost = min(row.get(j, far), left) + 1
            if j and (d := row.get(j - 1, far) + (text[start + j - 1] != ch)) < cost:
                cost = d
            left = cost
            if cost <= errors:
                new[j] = cost
        if not new:
            return {}
        row = new
    return {start + j: cost for j, cost in row.items()}


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end) those that overlap none of fewer edits, or further left, that is taken."""
    wide = max((b - a for _, a, b in spans), default=1)
    taken: dict[int, list[tuple[int, int]]] = {}  # by stretches as wide as the longest span: only neighbours can overlap
    out = []
    for edits, a, b in sorted(spans):
        at = a // wide
        if all(b <= x or y <= a for k in (at - 1, at, at + 1) for x, y in taken.get(k, ())):
            taken.setdefault(at, []).append((a, b))
            out.append((edits, a, b))
    return out


class Words:
    """Word numbers of places in a text of words joined by single spaces; looked up by bisection, prepared at first use."""

    def __init__(self, line: str):
        self.line, self.gaps = line, None

    def __call__(self, at: int) -> int:
        if self.gaps is None:
            self.gaps = np.flatnonzero(np.frombuffer(self.line.encode("utf-32-le"), "<u4") == 32)
        return int(np.searchsorted(self.gaps, at))


class Scanner:
    """Compiled notices; built once per Python worker."""

    def __init__(self, notices: dict[str, tuple[str, int, tuple[str, ...]]] | None = None):
        self.notices = [
            (p, label, e, set(core), pieces(p, e), regex.compile(rf"\b(?:{regex.escape(p)}){{e<={e}}}\b"))
            for p, (label, e, core) in (NOTICES if notices is None else notices).items()
        ]
        self.known: dict[tuple[int, str], list[tuple[int, int]]] = {}
        self.steps = 0  # places and windows looked at, for those who count

    def spans_at(self, number: int, window: str, at: int) -> list[tuple[int, int]]:
        """(edits, length) of the notice's occurrences that start at ``window[at]``; the window holds a character before and one after."""
        if (got := self.known.get((number, window))) is None:
            phrase, _, e, core, _, pattern = self.notices[number]
            self.steps += 1
            got = []
            if pattern.match(window, at):
                got = [
                    (edits, j - at) for j, edits in ends(phrase, e, window, at).items()
                    if j > at and window[j - 1] != " " and _EDGE.match(window, j) and core <= set(window[at:j].split())
                ]
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[number, window] = got
        return got

    def fuzzy(self, line: str, word: Words | None = None) -> list[Hit]:
        """Verified hits of one normalised text (words joined by one space)."""
        word = word or Words(line)
        hits: dict[tuple[str, int, int], Hit] = {}
        for number, (phrase, label, e, _, seeds, _) in enumerate(self.notices):
            starts: set[int] = set()
            for offset, seed in seeds:
                at = line.find(seed)
                while at >= 0:
                    self.steps += 1
                    # edits before the piece shift its start by their number at most
                    starts.update(range(max(0, at - offset - e), at - offset + e + 1))
                    at = line.find(seed, at + 1)
            found = []
            for i in starts:
                if i < len(line) and line[i] != " " and _EDGE.match(line, i):
                    lead = i > 0
                    window = line[i - lead : i + len(phrase) + e + 1]
                    found += [(edits, i, i + long) for edits, long in self.spans_at(number, window, int(lead))]
            for edits, i, j in apart(found):
                first = word(i)
                last = first + line.count(" ", i, j)
                hit = Hit(label, first, last, edits, 1.0 - edits / len(phrase))
                if (old := hits.get((label, first, last))) is None or hit.edits < old.edits:
                    hits[(label, first, last)] = hit
        return sorted(hits.values(), key=lambda h: (h.first, h.last, h.label))

    def __call__(self, text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[Hit]]:
        """Words, base places, smallest and largest base start, base labels, verified hits."""
        words = (text or "").encode("utf-8", "replace").translate(_BLANK).split()
        line = b" ".join(words).decode("utf-8")
        word = Words(line)
        framed, starts, labels = f" {line} ", [], set()
        for phrase, label in BASE.items():
            at = framed.find(f" {phrase} ")
            while at >= 0:
                starts.append(word(at))  # the frame's space stands where the place starts
                labels.add(label)
                at = framed.find(f" {phrase} ", at + 1)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), self.fuzzy(line, word)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts, positions, labels, score and ``spans`` (label, first, last, edits)."""
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scanner()
        for b in slices(batches):
            got = [of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64()), pa.array([",".join(g[4]) for g in got], pa.string()),
                    pa.array([",".join(sorted({*g[4], *(h.label for h in g[5])})) for g in got], pa.string()),
                    pa.array([1.0 if g[1] else max((h.score for h in g[5]), default=0.0) for g in got], pa.float64()),
                    pa.array([[{"label": h.label, "first": h.first, "last": h.last, "edits": h.edits} for h in g[5]] for g in got], pa.list_(span)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,edits:int>>"
    )
