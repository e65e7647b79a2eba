"""Token counts of whole texts by a tokenizers file: batches of about equal bytes, lengths only.

A long text is cut where no token can reach across: before a blank, a line end or an ASCII digit.  The
pre-tokeniser never puts white space into a piece and makes each digit a piece of its own, none of the three joins
with what stands before it under normalisation, and no special string holds one of them.  The counts of the parts
then add up to that of the text.  ``is_safe`` checks that a tokenizers file is of this kind.
"""

from __future__ import annotations

import heapq
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

PART = 1 << 16  # characters of a long text that go together, if it can be cut
BATCH = 1 << 19  # bytes that are encoded in one call
_SAFE = re.compile(r"[ \n0-9]")
_known: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        _known[path] = Tokenizer.from_file(path)
    return _known[path]


def is_safe(path: str) -> bool:
    """Do texts split at the safe boundaries have the same tokens as whole ones, on probes of every kind?"""
    t = _tokenizer(path)
    size = lambda s: len(t.encode(s, add_special_tokens=False))
    marks = [x.content for x in t.get_added_tokens_decoder().values()]
    if any(_SAFE.search(m) for m in marks):
        return False
    lefts = ["word", "café", "it's", "'", "...", "你好", "\U0001f600", "9", "٣", "a  ", "\t\r", " ", "가", *marks]
    rights = [" word", "\n\n'll", "7th", "0́x", " ́a", "  ", "1", " 你", *(" " + m for m in marks), *("5" + m for m in marks)]
    return all(size(a + b) == size(a) + size(b) for a in lefts for b in rights)


def parts_of(text: str, part: int = PART) -> list[str]:
    """``text`` cut at safe boundaries into parts of ``part`` characters or a little less; longer where there is no boundary."""
    if len(text) <= part:
        return [text]
    out, lo = [], 0
    while len(text) - lo > part:
        hi = max(text.rfind(c, lo + 1, lo + part + 1) for c in " \n0123456789")
        if hi <= lo:
            found = _SAFE.search(text, lo + part)
            if not found:
                break
            hi = found.start()
        out.append(text[lo:hi])
        lo = hi
    out.append(text[lo:])
    return out


def balanced(sizes: np.ndarray, limit: int = BATCH) -> list[np.ndarray]:
    """Row numbers in batches of about equal summed ``sizes``: ``limit`` / 2 on average, plus one row at most.

    Largest first, each to the lightest batch.
    """
    count = max(1, -(-int(sizes.sum()) // max(1, limit // 2)))
    heap = [(0, b) for b in range(count)]
    where: list[list[int]] = [[] for _ in range(count)]
    for k in np.argsort(-sizes, kind="stable").tolist():
        load, b = heapq.heappop(heap)
        where[b].append(k)
        heapq.heappush(heap, (load + int(sizes[k]), b))
    return [np.array(w) for w in where if w]


def _counts(texts: list[str], tokenizer) -> np.ndarray:
    own, parts = [], []
    for k, text in enumerate(texts):
        cut = parts_of(text)
        own += [k] * len(cut)
        parts += cut
    out = np.zeros(len(texts), dtype=np.int64)
    owner = np.array(own, dtype=np.int64)
    for batch in balanced(np.array([len(p.encode()) for p in parts], dtype=np.int64)) if parts else []:
        lengths = [len(e) for e in tokenizer.encode_batch_fast([parts[k] for k in batch.tolist()], add_special_tokens=False)]
        np.add.at(out, owner[batch], lengths)
    return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Counts are the library's own for the whole text, without begin and end tokens; special strings in a text
    are special tokens, as is its default.  Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and
    null ids pass through.  Empty table: no rows.  Only the two columns are read.  A stretch without blank, line
    end or digit stays one part, however long.  Raises ValueError for a tokenizers file whose tokens may
    reach across the boundaries.  No shuffle; only lengths leave Python.
    """
    ship_package(docs.sparkSession)
    if not is_safe(path):
        raise ValueError(f"tokens of {os.path.basename(path)} may reach across blanks, line ends or digits")

    def run(batches):
        tokenizer = _tokenizer(path)
        for rb in batches:
            for lo in range(0, rb.num_rows, 256):
                part = rb.slice(lo, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(_counts([t or "" for t in part.column(2).to_pylist()], tokenizer))], names=["id", "n_bytes", "n_tokens"]
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    got = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
