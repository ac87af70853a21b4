"""Byte-level BPE by monoid tree reduction: halves are encoded on their own and neighbours joined at their boundary.

Two monoids, one inside the other:

*Tokens of a piece.*  A piece of more than ``LEAF`` bytes is halved, the halves are encoded, and ``Merges.join`` puts them together.
It rests on a fact about greedy merging (lowest rank first, leftmost of equals): a token sequence is the encoding of its
bytes if and only if every two neighbours are the encoding of *their* bytes.  For as long as no merge
crosses a boundary, what happens between two neighbours happens in the order in which it would if
they stood alone, where no merge crosses their boundary either; so none ever does, and each token
comes out as itself.  So the join re-encodes a window of tokens around the boundary, and doubles it on each side until
the window's outermost tokens fit their neighbours outside: these, and all beyond, stay as they are.

*Pieces of a text.*  A text of more than ``SEGMENT`` characters is halved anywhere.  A match of PATTERN that ends two characters
before the cut, or earlier, looked at nothing beyond the cut (fixed values: a contraction looks two characters ahead, white space one, and
all other alternatives stop at the first character that doesn't fit), so it stands; from there matching
goes on across the cut until a match ends where one of the right half ends, and from there the right half stands, as matching has no memory.
A piece that spans the cut is the join of the tokens that both halves have of it.

Shorter texts fall apart at single spaces before other characters than white space, where a match always starts.
Decoding is the concatenation of the tokens' bytes up the same tree.  Encodings of short pieces and words are kept in caches of bounded bytes.

Defined edge cases: null is the empty text, which has no tokens; text in Spark is always valid UTF-8; the names of special tokens
are ordinary text; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, worker_state

#: Bytes of a piece, and characters of a text, up to which there are no halves; ids decoded at once.
LEAF, SEGMENT, IDS = 16, 65_536, 4_096
#: Bytes up to which merging needs no heap; above all ranks.
SHORT, NONE = 48, 1 << 62
#: Characters beyond its end that a match of PATTERN may look at.
AHEAD = 2
#: Caches of pieces and words: bytes, about, what an entry weighs beside its text and tokens, and the longest piece in it.
CACHE_BYTES, ENTRY_BYTES, LONG_PIECE = 256 << 20, 200, 128


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of lines ``base64 id``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Tokens of single pieces under ``ranks``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.of_id = ranks, {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing}")
        self.known: dict[tuple[int, int], bool] = {}

    def short(self, raw: bytes) -> list[int]:
        """Merging over few bytes: the least rank among all neighbours, again and again."""
        ranks = self.ranks
        at = list(range(len(raw) + 1))  # where tokens start, and the end
        near = [ranks.get(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]  # of tokens i and i + 1
        while near and (low := min(near)) != NONE:
            i = near.index(low)
            del at[i + 1], near[i]
            if i < len(near):
                near[i] = ranks.get(raw[at[i] : at[i + 2]], NONE)
            if i:
                near[i - 1] = ranks.get(raw[at[i - 1] : at[i + 1]], NONE)
        return [ranks[raw[a:b]] for a, b in pairwise(at)]

    def greedy(self, raw: bytes) -> list[int]:
        """Merging over all of ``raw``, by a heap of neighbours; links tell what stands beside what."""
        ranks, n = self.ranks, len(raw)
        if n <= SHORT:
            return self.short(raw)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at each byte
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, a, c = heapq.heappop(heap)
            b = end[a]
            if gone[a] or b >= n or end[b] != c:
                continue  # one of the two has changed since
            gone[b] = 1
            end[a] = c
            if c < n:
                left[c] = a
                if (r := ranks.get(raw[a : end[c]])) is not None:
                    heapq.heappush(heap, (r, a, end[c]))
            if (p := left[a]) >= 0 and (r := ranks.get(raw[p:c])) is not None:
                heapq.heappush(heap, (r, p, c))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        if (ok := self.known.get((a, b))) is None:
            if len(self.known) >= 1_000_000:
                self.known.clear()
            ok = self.known[a, b] = self.greedy(self.of_id[a] + self.of_id[b]) == [a, b]
        return ok

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.of_id.__getitem__, ids))

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings put together."""
        if not a or not b or self.fits(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            inner = self.greedy(self.bytes_of(a[-i:]) + self.bytes_of(b[:j]))
            on_left = i == len(a) or self.fits(a[-i - 1], inner[0])
            on_right = j == len(b) or self.fits(inner[-1], b[j])
            if on_left and on_right:
                return a[:-i] + inner + b[j:]
            i = i if on_left else min(len(a), 2 * i)
            j = j if on_right else min(len(b), 2 * j)

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.greedy(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of one match; a match that is a token is that token."""
        return [whole] if (whole := self.ranks.get(raw)) is not None else self.tree(raw)


class Known(dict):
    """text -> its tokens, made when first asked for; two generations of bounded bytes."""

    def __init__(self, make: Callable[[str], tuple[int, ...] | None], most: int):
        super().__init__()
        self.make, self.old, self.held, self.most = make, {}, 0, most

    def __missing__(self, text: str) -> tuple[int, ...] | None:
        got = self.old[text] if text in self.old else self.make(text)
        if len(text) <= LONG_PIECE:
            self.held += ENTRY_BYTES + 2 * len(text) + 8 * len(got or ())
            if self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[text] = got
        return got


@dataclass
class Part:
    """Tokens of a stretch of text; ``ends``: where each piece ends, ``upto``: tokens up to there."""

    start: int
    ends: array
    upto: array
    ids: array

    def tokens(self, first: int, last: int) -> list[int]:
        """Of the pieces first .. last - 1."""
        return list(self.ids[self.upto[first - 1] if first else 0 : self.upto[last - 1] if last else 0])


class Codec:
    """Encoder and decoder of whole texts; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.pattern = Merges(ranks), regex.compile(pattern)
        self.cache = Known(lambda piece: tuple(self.merges.piece(piece.encode("utf-8"))), CACHE_BYTES // 8)
        self.words = Known(self.after_space, CACHE_BYTES * 3 // 8)

    def stretch(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.cache.__getitem__, self.pattern.findall(text)))

    def after_space(self, word: str) -> tuple[int, ...] | None:
        """Tokens of a space and ``word``; None if no match need start at that space."""
        if not word or word[0].isspace():
            return None
        found = self.pattern.findall(" " + word)
        return tuple(self.merges.piece(f" {word}".encode())) if len(found) == 1 else tuple(chain.from_iterable(map(self.cache.__getitem__, found)))

    def encode(self, text: str) -> array:
        if len(text) > SEGMENT:
            return self.part(text, 0, len(text)).ids
        first, *words = text.split(" ")
        tokens = list(map(self.words.__getitem__, words))
        if None not in tokens:
            return array("I", chain(self.stretch(first), chain.from_iterable(tokens)))
        # a space before white space, or at the end, belongs to what stands before it: no match need start there
        out, held, known = array("I"), first, None
        for word, ids in zip(words, tokens, strict=True):
            if ids is None:
                held, known = f"{held} {word}", None
            else:
                out.extend(self.stretch(held) if known is None else known)
                held, known = f" {word}", ids
        out.extend(self.stretch(held) if known is None else known)
        return out

    def part(self, text: str, lo: int, hi: int) -> Part:
        if hi - lo > SEGMENT:
            half = (lo + hi) // 2
            return self.join(text, self.part(text, lo, half), self.part(text, half, hi), half)
        found = self.pattern.findall(text[lo:hi])
        ends = array("Q", accumulate(map(len, found), initial=lo))[1:]
        tokens = [self.cache[p] for p in found]
        return Part(lo, ends, array("Q", accumulate(map(len, tokens))), array("I", chain.from_iterable(tokens)))

    def join(self, text: str, a: Part, b: Part, cut: int) -> Part:
        """The stretch that two neighbours make; ``cut`` is where they meet."""
        stop = b.ends[-1]
        kept = bisect_right(a.ends, cut - AHEAD)  # matches that saw nothing beyond the cut
        at = a.ends[kept - 1] if kept else a.start
        ids = array("I", a.ids[: a.upto[kept - 1]] if kept else ())
        ends, upto = a.ends[:kept], a.upto[:kept]
        i, k = kept, 0
        while True:
            if at >= cut:
                k = bisect_left(b.ends, at)
                if at == cut or (k < len(b.ends) and b.ends[k] == at):
                    k += at != cut
                    break
            end = self.pattern.match(text, at, stop).end()
            ids.extend(self.spanning(text, at, end, a, b, cut, i))
            ends.append(end)
            upto.append(len(ids))
            at = end
            while i < len(a.ends) and a.ends[i] <= at:
                i += 1
        more, shift = b.ids[b.upto[k - 1] if k else 0 :], len(ids) - (b.upto[k - 1] if k else 0)
        ids.extend(more)
        ends.extend(b.ends[k:])
        upto.extend(array("Q", (u + shift for u in b.upto[k:])))
        return Part(a.start, ends, upto, ids)

    def spanning(self, text: str, at: int, end: int, a: Part, b: Part, cut: int, i: int) -> list[int] | tuple[int, ...]:
        """Tokens of the piece at .. end, whose first piece in ``a`` is number i."""
        if end - at <= LONG_PIECE:
            return self.cache[text[at:end]]
        first = a.ends[i - 1] if i else a.start
        last = bisect_left(b.ends, end)
        if at < cut < end and first == at and len(a.ends) == i + 1 and last == 0 and b.ends[0] == end:
            raw = text[at:end].encode("utf-8")
            whole = self.merges.ranks.get(raw)
            return [whole] if whole is not None else self.merges.join(a.tokens(i, i + 1), b.tokens(0, 1))
        return self.merges.piece(text[at:end].encode("utf-8"))

    def decode(self, ids: array | list[int]) -> bytes:
        """The bytes of all tokens: those of halves, put together."""
        if len(ids) <= IDS:
            return self.merges.bytes_of(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def little_endian(ids: array) -> bytes:
    import numpy as np

    return np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if len(ids) else b""


def _codec(ranks: dict[bytes, int], pattern: str, tag: str) -> Codec:
    held = worker_state()
    if held.get("bpe", (None,))[0] != tag:
        held["bpe"] = (tag, Codec(ranks, pattern))
    return held["bpe"][1]


def _mapped(df: DataFrame, columns: list[str], schema: str, path: str, pattern: str, make) -> DataFrame:
    """``df``'s columns and what ``make(codec, value of the last of them)`` gives, row by row."""
    ranks = read_ranks(path)
    shipped = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: one file, whatever the input
    tag = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern, tag)
        for b in slices(batches, 64):
            got = [make(codec, v) for v in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(columns) - 1)], *made], names=[*columns[:-1], *fields])

    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in columns[:-1]]
    return df.select(*columns).mapInArrow(run, ", ".join([*kept, schema]))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (binary: little-endian unsigned 32-bit) for every row of ``docs`` (doc_id, text)."""

    def make(codec: Codec, text: str | None) -> tuple[int, bytes]:
        ids = codec.encode(text or "")
        return len(ids), little_endian(ids)

    return _mapped(docs, ["doc_id", "text"], "n_tokens long, ids binary", path, pattern, make)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``decoded`` (binary) for every row of ``tokens`` (doc_id, ids), as ``encode`` makes them; null ids are none."""

    def make(codec: Codec, ids: bytes | None) -> tuple[bytes]:
        import numpy as np

        return (codec.decode(np.frombuffer(ids or b"", "<u4").tolist()),)

    return _mapped(tokens, ["doc_id", "ids"], "decoded binary", path, pattern, make)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` and ``decode`` give, in one pass that moves digests only."""

    def make(codec: Codec, text: str | None) -> tuple[int, str, str]:
        ids = codec.encode(text or "")
        return len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _mapped(docs, ["doc_id", "text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, make)
