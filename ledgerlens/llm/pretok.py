"""Pre-tokenisation without regular expressions: codepoint classes and a scan of transition functions.

Text becomes an array of code points, each mapped to a symbol (its class, with what must be known of its
next characters folded in).  A small automaton decides at each symbol whether a piece starts there.  Since
transition functions compose associatively, blocks of symbols are first turned into functions of the
unknown entry state, all blocks in parallel; a prefix scan over the blocks composes them; a second pass
with known entry states marks the starts.

The pieces are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\s L N]+|\\s+(?!\\S)|\\s+`` (L letters, N numbers).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, BLANK, SPACE, RESET = range(6)
#: The code points of the White_Space property other than U+0020.
WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SENTINEL = 0  # stands between texts of a batch; its class is taken by position, not by value
# Symbols: the classes up to OTHER, then an apostrophe that can open a contraction of 2 or 3 characters,
# a blank before a non-space, other white space before a non-space, white space before white space or the
# end, and the border between texts.
S_OPEN2, S_OPEN3, S_BLANK, S_LAST, S_MID, S_RESET = range(3, 9)
N_SYM = 9
FREE, IN_L, IN_N, IN_P, HELD, IN_SPACE, TAIL1, TAIL2 = range(8)
N_STATE = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    to = np.zeros((N_STATE, N_SYM), dtype=np.uint8)
    starts = np.ones((N_STATE, N_SYM), dtype=bool)
    for state in range(N_STATE):
        for sym, own in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_P)):
            to[state, sym], starts[state, sym] = own, state not in (own, HELD)
        for sym, tail in ((S_OPEN2, TAIL1), (S_OPEN3, TAIL2)):
            joins = state in (IN_P, HELD)  # then it is an ordinary sign of the piece
            to[state, sym], starts[state, sym] = (IN_P if joins else tail), not joins
        to[state, S_BLANK], to[state, S_LAST], to[state, S_MID] = HELD, FREE, IN_SPACE
        starts[state, S_MID] = state != IN_SPACE
    for state, after in ((TAIL2, TAIL1), (TAIL1, FREE)):
        to[state, :], starts[state, :] = after, False
    to[:, S_RESET], starts[:, S_RESET] = FREE, True
    return to, starts


_TO, _STARTS = _automaton()


@cache
def class_table() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    cat = unicodedata.category
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        k = kinds.get(cat(chr(c))[0])
        if k is not None:
            out[c] = k
    out[WHITE] = SPACE
    out[0x20] = BLANK
    return out


def _symbols(cp: np.ndarray, borders: np.ndarray) -> np.ndarray:
    cls = class_table()[cp]
    cls[borders] = RESET
    white = (cls == BLANK) | (cls == SPACE)
    before_word = np.empty(len(cp), dtype=bool)  # the next character exists and is no white space
    before_word[:-1] = ~white[1:] & (cls[1:] != RESET)
    before_word[-1] = False
    sym = cls.copy()
    sym[white] = np.where(before_word[white], np.where(cls[white] == BLANK, S_BLANK, S_LAST), S_MID)
    sym[borders] = S_RESET
    quote = np.flatnonzero(cp == 0x27)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(2, dtype=cp.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        sym[quote[short]], sym[quote[long]] = S_OPEN2, S_OPEN3
    return sym


def _turns(sym: np.ndarray) -> np.ndarray:
    """Places whose symbol may change the state: a repeated letter, number, sign or inner space does not,
    unless an apostrophe stands at most three places before it."""
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != sym[:-1]) | ~np.isin(np.arange(N_SYM), (LETTER, NUMBER, OTHER, S_MID))[sym[1:]]
    opens = np.flatnonzero((sym == S_OPEN2) | (sym == S_OPEN3))
    for k in (1, 2, 3):
        keep[np.minimum(opens + k, len(sym) - 1)] = True
    return np.flatnonzero(keep)


def _scan(sym: np.ndarray, width: int = 64) -> np.ndarray:
    """Where pieces start."""
    turns = _turns(sym)
    return turns[_marks(sym[turns], width)]


def _marks(sym: np.ndarray, width: int) -> np.ndarray:
    n = len(sym)
    rows = -(-n // width)
    grid = np.full(rows * width, S_RESET, dtype=np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = _TO.ravel()
    # Each block's function: its exit state for every entry state.
    block = np.broadcast_to(np.arange(N_STATE, dtype=np.uint8), (rows, N_STATE)).copy()
    for s in grid:
        block = flat[block * np.uint8(N_SYM) + s[:, None]]
    # Inclusive prefix composition over blocks, by doubling.
    prefix, step = block, 1
    while step < rows:
        later = prefix.copy()
        later[step:] = np.take_along_axis(prefix[step:], prefix[:-step].astype(np.intp), axis=1)
        prefix, step = later, step * 2
    state = np.full(rows, FREE, dtype=np.uint8)
    state[1:] = prefix[:-1, FREE]
    out, marks = np.empty(grid.shape, dtype=bool), _STARTS.ravel()
    for j, s in enumerate(grid):
        at = state * np.uint8(N_SYM) + s
        out[j], state = marks[at], flat[at]
    return out.T.ravel()[:n]


def _bounds(texts: list[str]):
    """(joined text, its code points, starts, ends, pieces per text, starts in their own texts)."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    borders = np.cumsum(lens + 1) - 1
    starts = _scan(_symbols(cp, borders))
    ends = np.append(starts[1:], len(cp))
    real = np.ones(len(cp), dtype=bool)
    real[borders] = False
    keep = real[starts]
    starts, ends = starts[keep], ends[keep]
    counts = np.diff(np.append(0, np.searchsorted(starts, borders)))
    return joined, cp, starts, ends, counts, starts - np.repeat(borders - lens, counts)


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces of all texts in order, pieces per text, start of each piece in its text in code points)."""
    joined, _, starts, ends, counts, at = _bounds(texts)
    return [joined[i:j] for i, j in zip(starts.tolist(), ends.tolist())], counts, at


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, dtype=np.uint64)] * 2


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def distinct_pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pieces, which of them stands at each place, pieces per text, starts in their texts).

    Pieces are grouped by a polynomial hash taken from prefix sums, and every member of a group is then
    compared with the group's first one, code point by code point; only distinct pieces become strings.
    """
    joined, cp, starts, ends, counts, at = _bounds(texts)
    if not len(starts):
        return [], np.zeros(0, dtype=np.int64), counts, at
    power, inverse = (t[: len(cp) + 1] for t in _power_tables(len(cp) + 1))
    v = (cp.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    sums = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(v * power[:-1], out=sums[1:])
    size = ends - starts
    key = (sums[ends] - sums[starts]) * inverse[starts] + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    shift = np.repeat(starts[first][which] - starts, size)
    place = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    if (size[first][which] == size).all() and (cp[place] == cp[place + shift]).all():
        own = [joined[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        return own, which, counts, at
    own = [joined[i:j] for i, j in zip(starts.tolist(), ends.tolist())]  # two pieces of one hash: take all as they are
    return own, np.arange(len(own)), counts, at


def batches_of(texts: list[str | None], most: int = 1_000_000):
    """(first, last, texts) of consecutive texts with about ``most`` characters; null as empty."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < most):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, hi, [t or "" for t in texts[lo:hi]]
        lo = hi
