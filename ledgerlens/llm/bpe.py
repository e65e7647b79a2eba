"""Byte-level BPE encoding and decoding: vectorised pre-tokenisation, then cached pair merging.

Encoding keeps the byte offset of every token.  Decoding puts each token's bytes at its offset, all tokens of
a batch at once, and can decode just the tokens that a stretch of bytes needs.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .pretok import batches_of, distinct_pieces

CACHE_PIECES = 400_000  # the bounds of a worker's cache, in pieces and in characters
CACHE_CHARS = 32_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: again and again the adjacent pair of least rank is merged, leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 120:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 40
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        best = min(pair)
        if best == none:
            break
        i = pair.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list: n log n steps, whatever the piece's length."""
    n = len(piece)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            r = ranks.get(piece[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if live[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], live[j] = stop, False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class _Places(dict):
    """piece -> place; an unseen piece gets the next place and is noted in ``new``."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []
        self.chars = sum(map(len, self))

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        self.new.append(piece)
        self.chars += len(piece)
        return at


class PieceTable:
    """Ids of pieces, merged once each.  ``encode_new`` gets the unseen pieces of a batch together and gives
    the order in which it took them, all their ids, and the number of ids of each.

    Beyond ``most`` pieces, those looked up once only go, and of the others the least used half; beyond
    ``chars`` characters in all of them, everything goes.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = CACHE_PIECES, chars: int = CACHE_CHARS):
        self.encode_new, self.most, self.chars = encode_new, most, chars
        self._clear()

    def _clear(self) -> None:
        self.at = _Places()
        self.start, self.size, self.uses = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(4096, dtype=np.int32), 0

    def _shrink(self) -> None:
        uses = self.uses[: len(self.at)]
        keep = np.flatnonzero(uses > max(1, np.partition(uses, len(uses) - self.most // 2)[len(uses) - self.most // 2] - 1))
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: self.most // 2]])
        words = list(self.at)
        size = self.size[keep]
        where = np.repeat(self.start[keep] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.flat, self.used = self.flat[where], int(size.sum())
        self.at = _Places((words[i], n) for n, i in enumerate(keep.tolist()))
        self.start, self.size, self.uses = np.cumsum(size) - size, size, uses[keep] // 2

    def ids(self, distinct: list[str], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, ids per piece); ``which`` tells the distinct piece at each place."""
        if self.at.chars > self.chars:
            self._clear()
        elif len(self.at) > self.most:
            self._shrink()
        n = len(self.at)
        places = np.fromiter(map(self.at.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        if new := self.at.new:
            order, flat, sizes = self.encode_new(new)
            full = n + len(new)
            self.start, self.size, self.uses = (self._room(a, full) for a in (self.start, self.size, self.uses))
            self.flat = self._room(self.flat, self.used + len(flat))
            self.start[n + order] = self.used + np.cumsum(sizes) - sizes
            self.size[n + order], self.uses[n:full] = sizes, 0
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.at.new = []
        which = places[which]
        self.uses[: len(self.at)] += np.bincount(which, minlength=len(self.at))
        size = self.size[which]
        where = np.repeat(self.start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.flat[where], size

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])


class Codec:
    """What a worker holds for a rank file: merged pieces, and the bytes of every token in one row."""

    def __init__(self, path: str):
        ranks = read_ranks(path)

        def encode_new(new: list[str]):
            got = [merge(p.encode("utf-8", "surrogatepass"), ranks) for p in new]
            sizes = np.array([len(g) for g in got], dtype=np.int64)
            return np.arange(len(new)), np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(sizes.sum())), sizes

        self.pieces = PieceTable(encode_new)
        self.width = np.full(max(ranks.values(), default=0) + 1, -1, dtype=np.int64)
        for b, i in ranks.items():
            self.width[i] = len(b)
        self.start = np.cumsum(np.maximum(self.width, 0)) - np.maximum(self.width, 0)
        self.bytes = np.frombuffer(b"".join(b for b, _ in sorted(ranks.items(), key=lambda x: x[1])), dtype=np.uint8)

    def widths(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.width) or (self.width[ids] < 0).any()):
            raise ValueError("an id that is not in the rank file")
        return self.width[ids]

    def place(self, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """``size`` bytes with each token's bytes at its place."""
        n = self.widths(ids)
        out, ends = np.zeros(size, dtype=np.uint8), np.cumsum(n)
        step = np.arange(int(n.sum())) - np.repeat(ends - n, n)
        out[np.repeat(at, n) + step] = self.bytes[np.repeat(self.start[ids], n) + step]
        return out


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _encode(batches, path):
    codec = _codec(path)
    for rb in batches:
        texts = rb.column(1).to_pylist()
        for lo, hi, part in batches_of(texts):
            own, which, per_text, _ = distinct_pieces(part)
            ids, size = codec.pieces.ids(own, which)
            last = np.append(0, np.append(0, np.cumsum(size))[np.cumsum(per_text)])
            tokens = np.diff(last)
            # Offsets: the byte at which each token starts in its text.
            ends = np.append(0, np.cumsum(codec.width[ids]))
            offsets = ends[:-1] - np.repeat(ends[last[:-1]], tokens)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).slice(lo, hi - lo), _lists(ids.astype(np.int32), tokens), _lists(offsets.astype(np.int32), tokens)], names=["id", "ids", "offsets"]
            )


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, offsets): token ids of each whole text by the rank file at ``path``.

    ``offsets[i]`` is the byte of the text's UTF-8 form at which token i starts, so tokens and stretches of
    text can be placed in each other.  Null and empty texts give empty lists.  Repeated rows give repeated
    rows; null ids stay.  Empty input: no rows.  Only the two columns are read.  A worker holds at most
    ``CACHE_PIECES`` merged pieces of ``CACHE_CHARS`` characters and one batch of about a million
    characters, or one text.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(lambda it: _encode(it, path), f"id {kind}, ids array<int>, offsets array<int>")
    return out.withColumnRenamed("id", id_col)


def _decode(batches, path):
    """The last four columns: ids, offsets, and the stretch's first byte and end (null: from the start, to the end)."""
    codec = _codec(path)
    for rb in batches:
        keep = rb.num_columns - 2
        ids, offsets, first, stop = (rb.column(rb.num_columns - k) for k in (4, 3, 2, 1))
        done: list[bytes | None] = []
        for k in range(rb.num_rows):
            if not ids[k].is_valid or not offsets[k].is_valid:
                done.append(None)
                continue
            own, at = ids[k].values.to_numpy().astype(np.int64), offsets[k].values.to_numpy().astype(np.int64)
            n = codec.widths(own)
            if len(own) != len(at) or (at != np.cumsum(n) - n).any():
                raise ValueError("offsets that do not fit the ids")
            size = int(n.sum())
            a = max(0, first[k].as_py() or 0)
            b = max(a, size if stop[k].as_py() is None else min(size, stop[k].as_py()))
            # Only tokens that reach into the stretch.
            i, j = (max(0, int(np.searchsorted(at, a, "right")) - 1), int(np.searchsorted(at, b, "left"))) if b > a else (0, 0)
            base = int(at[i]) if j > i else a
            raw = codec.place(own[i:j], at[i:j] - base, int(n[i:j].sum()))
            done.append(raw[a - base : b - base].tobytes())
        yield pa.RecordBatch.from_arrays([*rb.columns[:keep], pa.array(done, pa.binary())], names=[*rb.schema.names[:keep], "decoded"])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str = "offsets", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(id_col, ids_col, offsets_col, decoded): each token's bytes at its offset.

    ``start`` and ``end`` ask for a stretch of bytes only (end exclusive, cut to the text): the tokens that
    reach into it are found by their offsets, and no others are decoded.  Null lists give null.  Unknown ids
    and offsets that do not fit them raise.
    """
    ship_package(encoded.sparkSession)
    edge = lambda c: (F.lit(None) if c is None else c).cast("long")
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"), F.col(offsets_col).cast("array<int>").alias("offsets"), edge(start).alias("a"), edge(end).alias("b"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(lambda it: _decode(it, path), f"id {kind}, ids array<int>, offsets array<int>, decoded binary")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), F.col("offsets").alias(offsets_col), "decoded")
