"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by their own codebook; an index cell is a pair of centroids.  For a
query, centroid pairs are visited in order of their summed half scores, by a heap over the two sorted
lists, until the visited cells hold the wanted share of all entries; those entries are scored exactly.

Equal vectors are one entry, holding its smallest ids only as far as any answer can need them.  Neighbouring
cells are grouped into units of bounded size, and a cell too large for one is dealt into several.  An entry
goes to its one unit; a query goes to the units that hold a cell it visits, with the list of those cells,
and is multiplied with the entries of these cells only.  A task holds one unit's entries and streams queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, least_hashed, ship_package

SAMPLE = 8192  # vectors that the codebooks are fitted on, those of least hashed id
CENTROIDS = 64
UNIT_BYTES = 64 << 20  # of the entries that a task holds, at most
LEAST_UNIT = 1024  # entries below which a unit is not worth a task
SPAN = 4096  # entries that scores are held of at a time, for 256 queries


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k centroids (fewer if there are fewer distinct rows)."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * (x @ c.T) - (c * c).sum(axis=1)).argmax(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * len(second) + j) by descending first[i] + second[j] until they hold ``wanted`` entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, width = [(-(first[a[0]] + second[b[0]]), 0, 0)], len(second)
    out, got = [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if sizes[cell]:
            out.append(cell)
            got += int(sizes[cell])
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def _cells(batches, c1, c2, dim):
    half = dim // 2
    for rb in batches:
        x = _matrix(rb.column(rb.schema.get_field_index("vec")), dim)
        cell = nearest(x[:, :half], c1) * len(c2) + nearest(x[:, half:], c2)
        yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell, pa.int32())], names=[*rb.schema.names, "cell"])


class Units:
    """How cells are dealt: ``group`` of each cell, and each group's first unit and number of units."""

    def __init__(self, sizes: np.ndarray, shard: int):
        # Neighbouring cells fill a group up to ``shard`` entries; a larger cell has a group of its own.
        self.group, held, g = np.zeros(len(sizes), dtype=np.int64), 0, 0
        for cell, n in enumerate(sizes.tolist()):
            if held and held + n > shard:
                g, held = g + 1, 0
            self.group[cell], held = g, held + n
        total = np.bincount(self.group, weights=sizes, minlength=g + 1)
        self.count = np.maximum(1, np.ceil(total / shard)).astype(np.int64)
        self.first = np.append(0, np.cumsum(self.count)[:-1])


_DEALT = "u long, kind int, id long, ids array<long>, vec array<double>, cells array<int>"


def _rows(u, kind, ids, lists, vecs, cells):
    return pa.RecordBatch.from_arrays(
        [pa.array(u, pa.int64()), pa.array(np.full(len(u), kind, dtype=np.int32)), pa.array(ids, pa.int64()), lists, vecs, pa.array(cells, pa.list_(pa.int32()))],
        names=["u", "kind", "id", "ids", "vec", "cells"],
    )


def _dealt_entries(batches, units: Units):
    for rb in batches:
        vec, ids, cell = (rb.column(rb.schema.get_field_index(k)) for k in ("vec", "ids", "cell"))
        c, low = cell.to_numpy(), np.array([x[0] for x in ids.to_pylist()], dtype=np.int64)
        g = units.group[c]
        mixed = (low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        u = units.first[g] + (mixed % units.count[g].astype(np.uint64)).astype(np.int64)
        yield _rows(u, 0, low, ids, vec, [[x] for x in c.tolist()])


def _dealt_queries(batches, c1, c2, dim, sizes, wanted, units: Units):
    half = dim // 2
    for rb in batches:
        x, me = _matrix(rb.column(1), dim), rb.column(0).to_numpy()
        one, two = x[:, :half] @ c1.T, x[:, half:] @ c2.T
        for lo in range(0, len(x), 64):  # a query has a row for each unit that it visits
            u, at, cells = [], [], []
            for r in range(lo, min(lo + 64, len(x))):
                seen = np.sort(np.array(traverse(one[r], two[r], sizes, wanted), dtype=np.int64))
                g = units.group[seen]
                for part in np.split(seen, np.flatnonzero(np.diff(g)) + 1) if len(seen) else []:
                    k = units.group[part[0]]
                    for v in range(units.first[k], units.first[k] + units.count[k]):
                        u.append(v)
                        at.append(r)
                        cells.append(part.tolist())
            yield _rows(u, 1, me[at], pa.nulls(len(u), pa.list_(pa.int64())), rb.column(1).take(pa.array(at, pa.int64())), cells)


class _Unit:
    """One unit's entries, by cell."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        t = pa.Table.from_batches(batches).combine_chunks()
        cell = t.column("cells").combine_chunks().flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        self.x = _matrix(t.column("vec").combine_chunks(), dim)[order]
        ids = t.column("ids").to_pylist()
        self.ids = [ids[i] for i in order]
        cells, start = np.unique(cell[order], return_index=True)
        self.order, self.starts, self.ends = cells.tolist(), start, np.append(start[1:], len(cell))
        self.spans = {int(c): (int(a), int(b)) for c, a, b in zip(cells, self.starts, self.ends)}

    def best(self, q: np.ndarray, me: np.ndarray, cells: list[list[int]], k: int):
        """(query, id, score) of each query's k best among the entries of its cells."""
        visitors: dict[int, list[int]] = {}
        for r, own in enumerate(cells):
            for c in own:
                if c in self.spans:
                    visitors.setdefault(c, []).append(r)
        # SPAN entries at a time; what may still be among a query's best is all that is kept of a span.
        most, cut = k + 1, np.full(len(q), -np.inf)
        own, entry, score = [], [], []
        for at in range(0, len(self.x), SPAN):
            end = min(at + SPAN, len(self.x))
            scores = np.full((len(q), end - at), -np.inf)
            for c in self.order[np.searchsorted(self.ends, at, side="right") : np.searchsorted(self.starts, end)]:
                rows, (lo, hi) = visitors.get(c, ()), self.spans[c]
                if len(rows):
                    lo, hi = max(lo, at), min(hi, end)
                    scores[np.array(rows), lo - at : hi - at] = q[rows] @ self.x[lo:hi].T
            if end - at > most:
                cut = np.maximum(cut, np.partition(scores, end - at - most, axis=1)[:, end - at - most])
            r, h = np.nonzero((scores >= cut[:, None] - 1e-9) & (scores > -np.inf))
            own.append(r)
            entry.append(h + at)
            score.append(scores[r, h])
        own, entry, score = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (own, entry, score))
        fine = score >= cut[own] - 1e-9
        own, entry = own[fine], entry[fine]
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(len(q) + 1))
        out = []
        for r, i in enumerate(me.tolist()):
            hit = entry[order[bounds[r] : bounds[r + 1]]]
            # Always summed alike, so that equal pairs score equally wherever they are met.
            exact = np.einsum("ij,j->i", self.x[hit], q[r])
            rows = [(i, v, s) for h, s in zip(hit.tolist(), exact.tolist()) for v in self.ids[h] if v != i]
            rows.sort(key=lambda row: (-row[2], row[1]))
            out += rows[:k]
        return out


def _score(batches, dim, k):
    """Rows sorted by (u, kind): a unit's entries are held, the queries that follow them are streamed."""
    held, mark, unit = [], None, None
    for rb in batches:
        if not rb.num_rows:
            continue
        u, kind = rb.column("u").to_numpy(), rb.column("kind").to_numpy()
        new = np.flatnonzero((np.diff(u) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip(np.append(0, new).tolist(), np.append(new, len(u)).tolist()):
            part = rb.slice(lo, hi - lo)
            if u[lo] != mark:
                held, mark, unit = [], u[lo], None
            if kind[lo] == 0:
                held.append(part)
                continue
            if unit is None and held:
                unit, held = _Unit(held, dim), []
            for a in range(0, part.num_rows if unit else 0, 256):
                some = part.slice(a, 256)
                rows = unit.best(_matrix(some.column("vec"), dim), some.column("id").to_numpy(), some.column("cells").to_pylist(), k)
                cols = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", *,
    k: int = 20, visit: float = 0.6, centroids: int = CENTROIDS, sample: int = SAMPLE, shard: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query row.

    ``is_query`` is a condition on ``id_col``.  ``visit``: share of the index's entries in the visited
    cells; 1.0 is exact.  ``shard``: entries of a unit; by default there are about two units for each core,
    so that a query's rows do not grow with the table, but none of more than UNIT_BYTES.  Null ids, null, zero or empty
    vectors and those with null or non-finite components take no part, nor do vectors whose length is not
    the most common one (the shortest of equally common ones), with which no product is defined.  Rows of
    one id are one row, with the least of its vectors.  Ties go to the smaller id.  Only the two columns
    are read.  No usable vectors: no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    src = src.filter(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    common = src.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common.d
    half = dim // 2
    one = src.filter(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.max("is_query").alias("is_query"))
    one = scratch.keep(one, "vectors")
    some = one.join(F.broadcast(least_hashed(one, ["vec_id"], sample)), "vec_id", "left_semi").select("vec")  # a bounded sample
    x = np.array(sorted(r[0] for r in some.collect()), dtype=np.float64)
    c1, c2 = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)
    n_cells = len(c1) * len(c2)

    least = Window.partitionBy("vec").orderBy("vec_id")
    # The rank filter runs before the shuffle too, so a vector in a third of all rows sends few of them.
    entries = one.select("vec_id", "vec").withColumn("k", F.row_number().over(least)).filter(F.col("k") <= k + 1)
    entries = entries.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.keep(entries.mapInArrow(lambda it: _cells(it, c1, c2, dim), "vec array<double>, ids array<long>, cell int"), "entries")
    sizes = np.zeros(n_cells, dtype=np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most one row per cell
        sizes[r[0]] = r[1]
    total = int(sizes.sum())
    wanted = min(total, max(int(np.ceil(visit * total)), k + 1))  # k others at least, where there are as many
    if shard is None:
        even = -(-total // (2 * spark.sparkContext.defaultParallelism))
        shard = max(1, min(max(even, LEAST_UNIT), UNIT_BYTES // (8 * max(1, dim))))
    units = Units(sizes, shard)

    left = entries.mapInArrow(lambda it: _dealt_entries(it, units), _DEALT)
    right = one.filter("is_query").select("vec_id", "vec").mapInArrow(lambda it: _dealt_queries(it, c1, c2, dim, sizes, wanted, units), _DEALT)
    met = left.unionByName(right).repartition("u").sortWithinPartitions("u", "kind")
    found = met.mapInArrow(lambda it: _score(it, dim, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
