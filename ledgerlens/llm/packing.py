"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of n tokens costs ``linear * n + quadratic * n**2``, as a forward pass with attention within pieces
does.  Documents are packed block by block within a partition, without a shuffle: texts longer than a
sequence give whole sequences first; what is left of each document is taken in descending order and goes
to the open sequence of lowest cost that has room.  A block opens no more sequences than its tokens fill,
so a document that does not fit the remaining room is cut there and goes on in the next cheapest one: the
room left in all sequences of a block together is less than one sequence.  The one with most
room is carried over to the next block.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PieceTable
from .common import ship_package
from .pretok import batches_of, distinct_pieces

SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
_tables: dict[str, tuple[PieceTable, dict[str, int], re.Pattern]] = {}


def _table(path: str) -> tuple[PieceTable, dict[str, int], re.Pattern]:
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        marks = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        _tables[path] = PieceTable(_Encoder(t)), marks, re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True))) or r"(?!)")
    return _tables[path]


def text_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text as the library's call gives them: special strings are one id, and what is between them is
    tokenised by itself."""
    known, marks, pattern = _table(path)
    if not any(m in text for m in marks for text in texts):
        pieces, which, per_text, _ = distinct_pieces(texts)
        ids, per_piece = known.ids(pieces, which)
        ends = np.append(0, np.cumsum(np.append(0, per_piece))[np.cumsum(per_text)]).tolist()
        return [ids[lo:hi] for lo, hi in zip(ends, ends[1:])]
    parts, own, special = [], [], []  # stretches of ordinary text, whose they are, the special ids after each
    for k, text in enumerate(texts):
        lo = 0
        for m in pattern.finditer(text):
            parts.append(text[lo : m.start()])
            own.append(k)
            special.append(marks[m[0]])
            lo = m.end()
        parts.append(text[lo:] if lo else text)
        own.append(k)
        special.append(-1)
    pieces, which, per_part, _ = distinct_pieces(parts)
    ids, per_piece = known.ids(pieces, which)
    ends = np.append(0, np.cumsum(per_piece))[np.cumsum(per_part)]
    after = np.array(special, dtype=np.int32)
    at = np.flatnonzero(after >= 0)
    ids = np.insert(ids, ends[at], after[at])
    ends = ends + np.cumsum(after >= 0)
    last = np.flatnonzero(np.diff(np.append(own, len(texts))) != 0)
    return np.split(ids, ends[last][:-1]) if len(texts) else []


class _Encoder:
    """Ids of pieces by the tokenizers library.

    Pieces that are a blank and letters part again when they stand one after the other, so a hundred of
    them are one call; the ids are dealt back by the bytes they stand for.  Other pieces go one by one.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocab = tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # one character of a token's name is one byte

    def __call__(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grouped = np.fromiter((p[0] == " " and p[1:].isalpha() for p in new), dtype=bool, count=len(new))
        many, single = np.flatnonzero(grouped), np.flatnonzero(~grouped)
        words = [new[k] for k in many.tolist()]
        joined = ["".join(words[i : i + 100]) for i in range(0, len(words), 100)]
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(encode(joined)), dtype=np.int32)
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), dtype=np.int64, count=len(words)))
        cuts = np.searchsorted(np.cumsum(self.n_bytes[flat]), ends) + 1
        rest = encode([new[k] for k in single.tolist()])
        sizes = np.append(np.diff(np.append(0, cuts)), np.array([len(x) for x in rest], dtype=np.int64))
        return np.append(many, single), np.append(flat, np.fromiter(chain.from_iterable(rest), dtype=np.int32)), sizes.astype(np.int64)


def cost(n: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> float:
    return linear * n + quadratic * n * n


def assign(sizes: list[int], length: int, room0: int = 0, used0: int = 0, cost0: float = 0.0, linear: float = 1.0, quadratic: float = 1 / 1024):
    """Place documents of ``sizes`` (each below ``length``) into sequences.

    Returns (placements, open): placements are (document, start, n, sequence, offset); sequence 0 is one
    carried over with ``room0`` tokens of room when that is positive, the others are new.  open is
    (sequence, used, cost) of the one with most room, or None.
    """
    total = sum(sizes)
    more = max(0, -(-(total - room0) // length))
    rooms = [room0] + [length] * more
    spent = [cost0] + [0.0] * more
    heap = [(spent[k], k) for k in range(len(rooms)) if rooms[k] > 0]
    heapq.heapify(heap)
    used = [used0] + [0] * more
    out = []
    for d in sorted(range(len(sizes)), key=lambda d: (-sizes[d], d)):
        start, left = 0, sizes[d]
        while left:
            _, k = heapq.heappop(heap)
            n = min(left, rooms[k])
            out.append((d, start, n, k, used[k]))
            used[k] += n
            rooms[k] -= n
            spent[k] += cost(n, linear, quadratic)
            start, left = start + n, left - n
            if rooms[k]:
                heapq.heappush(heap, (spent[k], k))
    left_open = [(used[k], k) for k in range(len(rooms)) if rooms[k] and used[k]]
    if not left_open:
        return out, None
    k = min(left_open)[1]
    return out, (k, used[k], spent[k])


class _Packer:
    def __init__(self, length: int, linear: float, quadratic: float, part: int):
        self.length, self.linear, self.quadratic = length, linear, quadratic
        self.next, self.carried = part << 33, None  # ids are unique over partitions

    def block(self, docs: list[np.ndarray]):
        """Pieces (document, start, n, sequence, offset) of a block; all of them are final."""
        length, out, rest, base = self.length, [], [], []
        for d, ids in enumerate(docs):
            whole = len(ids) // length * length
            for s in range(0, whole, length):
                out.append((d, s, length, self.next, 0))
                self.next += 1
            if len(ids) > whole:
                rest.append(len(ids) - whole)
                base.append((d, whole))
        seq, used, spent = self.carried or (None, 0, 0.0)
        placed, open_ = assign(rest, length, length - used if self.carried else 0, used, spent, self.linear, self.quadratic)
        first = self.next - 1  # new sequences are numbered from 1 in assign
        top = 0
        for r, start, n, k, at in placed:
            d, skip = base[r]
            out.append((d, skip + start, n, seq if k == 0 else first + k, at))
            top = max(top, k)
        self.next += top
        self.carried = (seq if open_[0] == 0 else first + open_[0], *open_[1:]) if open_ else None
        return out


def _pack(batches, path, length, end_id, block_docs, linear, quadratic):
    packer = _Packer(length, linear, quadratic, TaskContext.get().partitionId())
    held_ids: list = []
    held: list[np.ndarray] = []
    size = 0

    def flush():
        rows = packer.block(held)
        for lo in range(0, len(rows), 4096):
            part = rows[lo : lo + 4096]
            ids = [held[d][s : s + n] for d, s, n, _, _ in part]
            counts = np.array([len(x) for x in ids])
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([held_ids[d] for d, *_ in part], pa.int64()), pa.array([s for _, s, *_ in part], pa.int64()), pa.array(counts, pa.int64()), lists,
                    pa.array([len(held[d]) for d, *_ in part], pa.int64()), pa.array([q for *_, q, _ in part], pa.int64()), pa.array([o for *_, o in part], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    for rb in batches:
        doc_ids = rb.column(0).to_pylist()
        for lo, hi, part in batches_of(rb.column(1).to_pylist(), 2_000_000):
            for k, ids in enumerate(text_ids(part, path)):
                held_ids.append(doc_ids[lo + k])
                held.append(np.append(ids, np.int32(end_id)))
                size += len(held[-1])
            if len(held) >= block_docs or size >= block_docs * 1024:
                yield from flush()
                held_ids, held, size = [], [], 0
    if held:
        yield from flush()


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *,
    length: int = 1024, end_id: int = 0, block_docs: int = 4096, linear: float = 1.0, quadratic: float = 1 / 1024,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Token ids come from the tokenizers file at ``path``, as its library's call gives them (special strings in a
    text are their one id), then ``end_id``.  Each id of a document is in one
    piece; a sequence holds at most ``length`` ids, its pieces gapless from offset 0.  Null and empty texts
    are the end id alone.  Repeated rows are packed each for itself; null ids stay null.  Empty input: no
    rows.  Only the two columns are read.  ``block_docs``: documents packed together, or 1024 times as
    many tokens; a task holds one such block.  Sequence ids are unique, not dense.
    """
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _pack(it, path, length, end_id, block_docs, linear, quadratic), SCHEMA)


def with_crc(packed: DataFrame) -> DataFrame:
    """``packed`` with ids_crc32 instead of ids: unsigned crc32 of the ids as little-endian 32-bit numbers."""

    def run(batches):
        for rb in batches:
            at = rb.schema.get_field_index("ids")
            col = rb.column(at)
            flat, offs = col.values.to_numpy(zero_copy_only=False).astype("<u4"), col.offsets.to_numpy()
            crc = pa.array([zlib.crc32(flat[offs[k] : offs[k + 1]].tobytes()) for k in range(rb.num_rows)], pa.int64())
            cols = [crc if k == at else rb.column(k) for k in range(rb.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=["ids_crc32" if n == "ids" else n for n in rb.schema.names])

    return packed.mapInArrow(run, SCHEMA.replace("ids array<int>", "ids_crc32 long"))
