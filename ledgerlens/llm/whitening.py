"""Whitening of embeddings by exact principal components.

Vectors become whole numbers, so their scatter matrix M = n * sum(x x') - S S' is exact: tasks sum products of
20-bit limbs.  M is d by d and all that leaves Spark.  Its characteristic polynomial comes from residues modulo
many primes (Hessenberg form, a batch of primes per task) and Chinese remaindering; as all its roots are real, the
number of sign changes after a shift counts the roots above a point exactly, which isolates each eigenvalue;
signs then refine it to some 160 bits.  A component is the null vector of M - e I by inverse iteration in
fixed-point numbers; equal eigenvalues share an orthonormal basis.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_package

LIMB = 20  # bits of a limb: products of limbs stay exact in doubles over BLOCK rows
BLOCK = 8192
WORDS = 6  # 32-bit words in which tasks hand on their sums
REFINED = 160  # bits of an eigenvalue, relative to itself
ALIKE = 80  # eigenvalues that agree to so many bits share their eigenspace
AT_ONCE = 8  # primes per batch


# --- sums over the table ---------------------------------------------------------------------------------------


def _rows(col) -> np.ndarray:
    """The 64-bit numbers of an array column whose arrays are equally long, a row each."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers.  Limbs are signed like their number; blocks keep every product sum below 2**53."""
    d = x.shape[1]
    out = np.zeros((d, d), dtype=object)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        sign, size = np.where(part < 0, -1.0, 1.0), np.where(part < 0, 0 - part.astype(np.uint64), part.astype(np.uint64))
        limbs = []
        while not limbs or size.any():
            limbs.append(sign * (size & np.uint64((1 << LIMB) - 1)).astype(np.float64))
            size = size >> np.uint64(LIMB)
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                out = out + (left.T @ right).astype(np.int64).astype(object) * (1 << LIMB * (a + b))
    return out


def _words(v: int) -> list[int]:
    sign, v = (-1, -v) if v < 0 else (1, v)
    return [sign * ((v >> 32 * k) & 0xFFFFFFFF) for k in range(WORDS)]


def _sums(batches):
    n, total, products = 0, None, None
    for rb in batches:
        if not rb.num_rows:
            continue
        x = _rows(rb.column(0))
        own = gram(x)
        n += len(x)
        products = own if products is None else products + own
        # Column sums by halves: those of 64-bit numbers may need more bits.
        high, low = x >> 32, x & 0xFFFFFFFF
        own = high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
        total = own if total is None else total + own
    if n:
        d = len(total)
        rows = [(-1, -1, n), *((-1, j, int(total[j])) for j in range(d)), *((i, j, int(products[i, j])) for i in range(d) for j in range(i, d))]
        words = np.array([_words(v) for *_, v in rows], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, *_ in rows], pa.int32()), pa.array([j for _, j, _ in rows], pa.int32()), *(pa.array(words[:, k]) for k in range(WORDS))],
            names=["i", "j", *(f"w{k}" for k in range(WORDS))],
        )


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of a table of ``x`` arrays: the driver gets d * (d + 3) / 2 + 1 rows, whatever the table's size."""
    schema = "i int, j int, " + ", ".join(f"w{k} long" for k in range(WORDS))
    found = fit.select("x").mapInArrow(_sums, schema).groupBy("i", "j").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(WORDS)])
    values = {(r[0], r[1]): sum(int(w) << 32 * k for k, w in enumerate(r[2:])) for r in found.collect()}
    if not values:
        return 0, [], []
    n = values[-1, -1]
    d = sum(1 for i, j in values if i == -1 and j >= 0)
    s = [values[-1, j] for j in range(d)]
    return n, s, [[n * values[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


# --- characteristic polynomial -----------------------------------------------------------------------------------


def primes_below(top: int, bits: int) -> list[int]:
    """Largest primes below ``top`` (at most 2**31), as many as have a product of more than ``bits`` bits."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # decides all numbers below 3.2e9
            if p % base == 0:
                return p == base
            y = pow(base, odd, p)
            if y in (1, p - 1):
                continue
            if not any((y := y * y % p) == p - 1 for _ in range(twos - 1)):
                return False
        return True

    out, have, p = [], 0.0, top - 1
    while have <= bits:
        if prime(p):
            out.append(p)
            have += math.log2(p) - 1e-9
        p -= 1
    return out


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.array([pow(int(v), -1, int(q)) for v, q in zip(a, p)], dtype=np.int64)


def hessenberg_polynomials(m: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(x I - m), highest first, modulo each prime (a row each)."""
    d, p = len(m), np.array(primes, dtype=np.int64)
    h = np.array([[[v % q for v in row] for row in m] for q in primes], dtype=np.int64)
    mod, each = p[:, None, None], np.arange(len(p))
    for k in range(1, d - 1):
        # A pivot below the diagonal of column k - 1; where there is none, the column is done.
        below = h[:, k:, k - 1] != 0
        at = k + below.argmax(1)
        some = below.any(1)
        own, other = h[each, k].copy(), h[each, at].copy()
        h[each, k], h[each, at] = other, own
        own, other = h[each, :, k].copy(), h[each, :, at].copy()
        h[each, :, k], h[each, :, at] = other, own
        inverse = _inverse(np.where(some, h[:, k, k - 1], 1), p)
        u = h[:, k + 1 :, k - 1] * inverse[:, None] % p[:, None]
        h[:, k + 1 :] = (h[:, k + 1 :] - u[:, :, None] * h[:, k][:, None, :]) % mod
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1 :] * u[:, None, :] % mod).sum(2)) % p[:, None]
    # poly[k]: characteristic polynomial of the leading k by k block, lowest coefficient first.
    poly = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        now = np.zeros((len(p), d + 1), dtype=np.int64)
        now[:, 1:] = poly[k - 1][:, :-1]
        now = (now - h[:, k - 1, k - 1][:, None] * poly[k - 1]) % p[:, None]
        chain = np.ones(len(p), dtype=np.int64)
        for i in range(1, k):
            chain = chain * h[:, k - i, k - i - 1] % p
            now = (now - (chain * h[:, k - i - 1, k - 1] % p)[:, None] * poly[k - i - 1]) % p[:, None]
        poly[k] = now
    return poly[d][:, ::-1]


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - m), highest first, for a positive semidefinite ``m``.

    The coefficients are elementary symmetric functions of eigenvalues that are not negative, so none is larger
    than (1 + trace / d) ** d; that says how many primes are enough.  Primes are Spark's rows.
    """
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    primes = primes_below(1 << 31, d * (max(1, trace // d + 1) + 1).bit_length() + 2)

    def run(batches):
        for rb in batches:
            own = rb.column(0).to_pylist()
            for lo in range(0, len(own), AT_ONCE):
                part = own[lo : lo + AT_ONCE]
                residues = hessenberg_polynomials(m, part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(residues.tolist(), pa.list_(pa.int64()))], names=["p", "c"])

    tasks = max(1, min(len(primes) // AT_ONCE, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    out, have = [0] * (d + 1), 1
    for p, residues in sorted((r[0], r[1]) for r in rows):
        step = pow(have, -1, p)
        out = [a + have * ((r - a) * step % p) for a, r in zip(out, residues)]
        have *= p
    return [a - have if 2 * a > have else a for a in out]


# --- eigenvalues --------------------------------------------------------------------------------------------------


def roots_above(c: list[int], num: int, bits: int) -> int:
    """How many roots of ``c`` (highest first; all real) exceed num / 2**bits, each as often as it occurs."""
    c = [v << bits * k for k, v in enumerate(c)]  # roots times 2**bits
    for stop in range(len(c), 1, -1):
        for k in range(1, stop):
            c[k] += num * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(c: list[int], num: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(c):
        value = value * num + (v << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(c: list[int], count: int) -> list[tuple[int, int]]:
    """The ``count`` largest positive roots as (num, bits) for num / 2**bits, falling, each as often as it occurs.

    A root is within 2**-REFINED of itself.  ``c``: highest first, leading 1, roots real and not negative.
    """
    while len(c) > 1 and c[-1] == 0:
        c = c[:-1]
    out = []
    for k in range(1, min(count, len(c) - 1) + 1):
        lo, hi, bits = 0, 1 - c[1], 0  # the sum of all roots, and one
        above_lo, above_hi = len(c) - 1, 0
        while (hi - lo) << REFINED > lo:
            if above_lo - above_hi == 1:
                break
            lo, hi, bits = lo * 2, hi * 2, bits + 1
            mid = (lo + hi) // 2
            above = roots_above(c, mid, bits)
            if above >= k:
                lo, above_lo = mid, above
            else:
                hi, above_hi = mid, above
        # One root in (lo, hi], so the sign right above it tells on which side of a point it is.
        while (hi - lo) << REFINED > lo:
            lo, hi, bits = lo * 2, hi * 2, bits + 1
            mid = (lo + hi) // 2
            side = _sign(c, mid, bits)
            if side == 0:
                lo = hi = mid
            elif side == (-1) ** (k - 1):
                hi = mid
            else:
                lo = mid
        out.append((lo + hi, bits + 1))
    return out


# --- eigenvectors -------------------------------------------------------------------------------------------------


def _solver(a: np.ndarray, bits: int):
    """Solves a y = b for fixed-point ``a`` (``bits`` after the point) by Gaussian elimination with row pivots."""
    d, a = len(a), a.copy()
    order, factors = list(range(d)), []
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, at]] = a[[at, k]]
        order[k] = at
        if a[k, k] == 0:
            a[k, k] = 1  # the last bit: as near to singular as can be told
        f = (a[k + 1 :, k] << bits) // a[k, k]
        factors.append(f)
        if k + 1 < d:
            a[k + 1 :, k + 1 :] -= (f[:, None] * a[k, k + 1 :][None, :]) >> bits

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k in range(d):
            b[[k, order[k]]] = b[[order[k], k]]
            b[k + 1 :] -= (factors[k] * b[k]) >> bits
        y = np.zeros(d, dtype=object)
        for k in range(d - 1, -1, -1):
            y[k] = ((b[k] - (int((a[k, k + 1 :] * y[k + 1 :]).sum() if k + 1 < d else 0) >> bits)) << bits) // a[k, k]
        return y

    return solve


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    norm = math.isqrt(int((v * v).sum()) << 2 * bits)
    return (v << 2 * bits) // norm


def components(m: list[list[int]], roots: list[tuple[int, int]]) -> list[list[float]]:
    """A unit eigenvector of ``m`` for each of ``roots`` (falling); the largest entry of each is positive."""
    d, out, group = len(m), [], []
    whole = np.array(m, dtype=object).reshape(d, d)
    for r, (num, bits) in enumerate(roots):
        before = roots[r - 1] if r else None
        if before and abs(before[0] << bits) - (num << before[1]) << ALIKE > num << before[1]:
            group = []
        at = max(bits, 256 + max(0, bits - num.bit_length()))
        start = np.array([(((i + 1) * 2654435761 * (2 * r + 1)) % 1000003 + 1) << at for i in range(d)], dtype=object)
        solve = _solver((whole << at) - np.eye(d, dtype=object) * (num << at - bits), at)
        v = start
        for _ in range(4):
            for g, g_at in group:  # keep away from what the same eigenvalue has given
                g = (g << at) >> g_at
                v = v - ((g * (int((g * v).sum()) >> at)) >> at)
            v = solve(_unit(v, at))
        for g, g_at in group:
            g = (g << at) >> g_at
            v = _unit(v, at)
            v = v - ((g * (int((g * v).sum()) >> at)) >> at)
        v = _unit(v, at)
        group.append((v, at))
        lead = max(range(d), key=lambda i: (abs(v[i]), -i))
        sign = -1 if v[lead] < 0 else 1
        out.append([sign * int(e) / (1 << at) for e in v])
    return out


# --- the operator -------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What is learned: rows ``n`` and sums ``s`` of the fit list, eigenvalues of its scatter and their vectors."""

    n: int
    s: list[int]
    roots: list[float]  # square roots of the eigenvalues of M = n * n * V
    shares: list[float]
    vectors: list[list[float]]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of the rows of ``x``."""
        top = max([abs(int(x.min())), abs(int(x.max()))]) if x.size else 0
        if self.n * top + max(map(abs, self.s)) < 1 << 62:
            y = (x * np.int64(self.n) - np.array(self.s, dtype=np.int64)).astype(np.float64)
        else:
            y = (x.astype(object) * self.n - np.array(self.s, dtype=object)).astype(np.float64)
        return y @ np.array(self.vectors).T / np.array(self.roots)

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)**2) per row, as n^2 x.x - 2 n x.S + S.S over exact sums."""
        n, ss = self.n, sum(v * v for v in self.s)
        top = max([abs(int(x.min())), abs(int(x.max()))]) if x.size else 0
        if top * max(top, *map(abs, self.s)) * max(1, len(self.s)) < 1 << 62:
            xx, xs = (x * x).sum(1).tolist(), (x @ np.array(self.s, dtype=np.int64)).tolist()
        else:
            big = x.astype(object)
            xx, xs = (big * big).sum(1).tolist(), (big * np.array(self.s, dtype=object)).sum(1).tolist()
        return [n * n * int(a) - 2 * n * int(b) + ss for a, b in zip(xx, xs)]


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, x): x = floor(scale * c) of each entry; rows whose vector is null, empty or not finite throughout go.

    Entries beyond 64 bits become the nearest 64-bit number.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    low, high = -(2.0**63), 2.0**63
    bounded = F.transform(v, lambda e: F.greatest(F.lit(low), e.cast("double") * scale))
    x = F.transform(bounded, lambda e: F.when(e >= high, F.lit(2**63 - 1)).otherwise(F.floor(F.when(e < high, e))))
    return df.filter(v.isNotNull() & finite & (F.size(v) > 0)).select(F.col(id_col).alias("id"), x.alias("x"))


def fit(spark, fit_list: DataFrame, count: int = 4) -> Whitening:
    """Learn from a table of distinct ``x``.  Fewer components come out where the scatter has lower rank."""
    n, s, m = scatter(fit_list)
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return Whitening(n, s, [], [], [])
    roots = largest_roots(characteristic_polynomial(spark, m), count)
    vectors = components(m, roots)
    return Whitening(n, s, [math.isqrt(num << 256 + bits % 2) / (1 << 128 + (bits + bits % 2) // 2) for num, bits in roots], [num / (trace << bits) for num, bits in roots], vectors)


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance less the identity, over the fit list, centred by its mean.

    Tasks give their count, mean and centred products; the driver merges one row a task.
    """
    k = len(model.roots)

    def run(batches):
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for rb in batches:
            if rb.num_rows:
                n, mean, products = _merged(n, mean, products, *_moments(model.project(_rows(rb.column(0)))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])], names=["n", "mean", "p"])

    n, mean, products = 0, np.zeros(k), np.zeros((k, k))
    for own in fit_list.select("x").mapInArrow(run, "n long, mean array<double>, p array<double>").collect():
        n, mean, products = _merged(n, mean, products, own[0], np.array(own[1]), np.array(own[2]).reshape(k, k))
    return float(np.abs(products / n - np.eye(k)).max())


def _moments(w: np.ndarray):
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _merged(n, mean, products, m, other, more):
    d = other - mean
    return n + m, mean + d * (m / (n + m)), products + more + np.outer(d, d) * (n * m / (n + m))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, count: int = 4, scale: int = 256) -> DataFrame:
    """A row per remaining row of ``df`` and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries go.  Vectors of several lengths have no common
    covariance: the commonest length (ties: the longer) stays.  Each distinct quantised vector counts once in the
    fit; all rows are projected, repeated rows and null ids included.  Components beyond the rank of the
    covariance have no variance to divide by and give no rows, so a table of one distinct vector gives
    none, and neither does an empty one.  ``deviation`` is a text of decimal digits, exact at any size.  Only the two columns are read.
    The driver works on the d by d scatter: d is bounded by the vectors' length, not by the table.
    """
    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    rows = quantised(df, id_col, vector_col, scale)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("x") == (lengths[0][0] if lengths else 0))
    distinct = scratch.keep(rows.select("x").distinct(), "fit")
    model = fit(spark, distinct, count)
    k = len(model.roots)
    error = identity_error(distinct, model) if k else 0.0
    scratch.drop(distinct)

    def run(batches):
        for rb in batches:
            if not k or not rb.num_rows:
                continue
            x = _rows(rb.column(1))
            white = model.project(x)
            owner = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    rb.column(0).take(pa.array(owner)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(owner), model.n)),
                    pa.array([str(v) for v in model.deviations(x)]).take(pa.array(owner)), pa.array(white.ravel()), pa.array(np.tile(np.array(model.shares), len(x))),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation string, whitened double, explained double")
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
