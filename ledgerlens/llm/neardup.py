"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Texts with the same shingle set form a class, numbered in the order of its smallest id; the number stands
   for it from here on, so that an id with several texts is in several classes.
2. Banded MinHash signatures put classes into buckets.  In a bucket, pairs are made star-wise: the
   first member is compared with all others.  Links contract components, and later rounds only
   compare members of different components, so a bucket of many mutual copies never costs its square.
   For these, shingles that occur in one component only are counted out: with c of n shingles left, x and
   y share at most min(c_x, c_y), which bounds their similarity.  Pairs whose bound is under the threshold
   are not made, and the member with the largest c/n, the most central one, is the next star's centre.
   After the star rounds all cross-component pairs that the bound allows are compared, bucket by bucket,
   blocks of rows against blocks of rows: nothing is capped, and only what passes step 3 becomes a row.
3. Each candidate's signatures are compared in batches.  With a uniform prior, the similarity's
   posterior after m matches among n is Beta(m+1, n-m+1); the pair is pruned once
   P(similarity >= threshold) falls below the miss probability divided by the number of batches.
   In the last round a second bound follows that misses nothing: with shingles counted by hash into 512
   cells, two sets share at most the sum of the lesser counts.
4. Survivors are verified exactly on the full shingle sets (100 * |A n B| >= 100t * |A u B|).  A star's centre
   is sent to each task that holds some of its pairs once, and is followed there by the other ends, streamed.

Keys that hold more than a thousandth of the rows (buckets, shingles, star centres) are dealt into several
tasks wherever rows meet by key.  The pairs left for step 3's last round cost, for a bucket of m members that
are still in several components, m * m / 512 rows of about 1.7 KB.

Shingles are compared by 64-bit hash, classes by a 128-bit digest of the set.
"""

from __future__ import annotations

from collections import OrderedDict
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, salted, ship_package, spread
from .components import components
from .shingles import hash_family, set_digest, shingle_set, signatures

BANDS, ROWS, CHECKED = 48, 6, 128
CELLS, BLOCK, STAR = 512, 512, 64


def prune_table(checked: int, batch: int, threshold: float, miss: float) -> list[int]:
    """For each batch end n: the fewest matches with P(S >= threshold | m of n) >= miss / batches.

    P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m).
    """
    ends = range(batch, checked + 1, batch)
    out = []
    for n in ends:
        cdf, m = 0.0, -1
        while cdf < miss / len(ends):
            m += 1
            cdf += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _sketch(batches, width):
    a, b = hash_family(BANDS * ROWS)
    for rb in batches:
        ids, hashes, texts = rb.column(0), rb.column(1), rb.column(2)
        lo = 0
        while lo < len(ids):  # at most about 2 MB of text, or one document, at a time
            hi, size, sets = lo, 0, []
            while hi < len(ids) and size < 2_000_000:
                t = texts[hi].as_py()
                size += len(t or "")
                sets.append(shingle_set(t, width))
                hi += 1
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = np.zeros((len(sets), BANDS * ROWS), dtype=np.uint32)
            if full:
                sig[full] = signatures([sets[k] for k in full], a, b)
            # A band's key: its rows folded by odd multipliers, with the band's number mixed in.
            keys = np.full((len(sets), BANDS), np.uint64(0x2545F4914F6CDD1D), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                keys = (keys ^ sig[:, r::ROWS].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                keys ^= keys >> np.uint64(29)
            digests = [set_digest(s) if len(s) else (None, None) for s in sets]
            short = sig[:, :CHECKED].astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    hashes.slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([short[k].tobytes() for k in range(len(sets))], pa.binary()),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                ],
                names=["id", "h", "n", "d1", "d2", "sig", "bands"],
            )
            lo = hi


def _members(batches, width):
    """(label, id, s) for each shingle s of each text."""
    for rb in batches:
        for k in range(rb.num_rows):
            s = shingle_set(rb.column(2)[k].as_py(), width)
            for lo in range(0, len(s), 65536):
                part = pa.array(s[lo : lo + 65536].view(np.int64))
                same = [pa.array(np.full(len(part), rb.column(c)[k].as_py(), dtype=np.int64)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, part], names=["label", "id", "s"])


def _bayes(batches, least, batch, percent):
    """Keeps the candidates (a, b) that no batch end prunes."""
    for rb in batches:
        n = rb.num_rows
        if not n:
            continue
        cols = {name: rb.column(name) for name in ("na", "nb")}
        na, nb = (cols[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("na", "nb"))
        x, y = (np.frombuffer(b"".join(rb.column(k).to_pylist()), dtype=np.uint16).reshape(n, -1) for k in ("sa", "sb"))
        live = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))  # sizes alone rule the rest out
        matches = np.zeros(len(live), dtype=np.int64)
        for k, need in enumerate(least):
            part = slice(k * batch, (k + 1) * batch)
            matches += (x[live, part] == y[live, part]).sum(axis=1)
            stay = matches >= need
            live, matches = live[stay], matches[stay]
        yield pa.RecordBatch.from_arrays([rb.column("a").take(pa.array(live)), rb.column("b").take(pa.array(live))], names=["a", "b"])


def _exact(batches, percent, width):
    """Links (a, b) among rows sorted by (hub, salt, member): a hub's own row (member null) comes first."""
    mark, centre = None, None
    for rb in batches:
        hub, member, text = rb.column("hub").to_pylist(), rb.column("member").to_pylist(), rb.column("text")
        salt = rb.column("salt").to_pylist()
        yes = []
        for k in range(rb.num_rows):
            if member[k] is None:
                mark, centre = (hub[k], salt[k]), shingle_set(text[k].as_py(), width)
                continue
            if mark != (hub[k], salt[k]):
                raise ValueError("a pair without its centre")
            t = shingle_set(text[k].as_py(), width)
            both = len(centre) + len(t) - len(np.union1d(centre, t))
            if 100 * both >= percent * (len(centre) + len(t) - both):
                yes.append((min(hub[k], member[k]), max(hub[k], member[k])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in yes], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verified(scratch, pairs, reps, texts, least, batch, percent, width):
    """Links among candidate pairs (a, b): Bayesian pruning if there are signatures, then exact sets."""
    alive = pairs
    if reps is not None:
        sigs = lambda k: reps.select(F.col("id").alias(k), F.col("sig").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
        cand = pairs.join(sigs("a"), "a").join(sigs("b"), "b")
        alive = cand.mapInArrow(lambda it: _bayes(it, least, batch, percent), "a long, b long")
    alive = scratch.keep(alive, "alive")
    # The end with more pairs is the centre; its text goes once to each of its stretches of STAR pairs.
    ends = alive.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("c"))
    own = lambda k: ends.select(F.col("id").alias(k), F.col("c").alias(f"c{k}"))
    first = F.col("ca") >= F.col("cb")
    stars = alive.join(own("a"), "a").join(own("b"), "b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest("ca", "cb").alias("c")
    )
    stars = scratch.keep(stars.withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("c") / STAR)).cast("int")).drop("c"), "stars")
    text = texts.select(F.col("id"), "text")
    centres = stars.select("hub", "salt").distinct().join(text, F.col("hub") == F.col("id")).select("hub", "salt", F.lit(None).cast("long").alias("member"), "text")
    members = stars.join(text, F.col("member") == F.col("id")).select("hub", "salt", "member", "text")
    met = centres.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    links = scratch.keep(met.mapInArrow(lambda it: _exact(it, percent, width), "a long, b long"), "links")
    scratch.drop(alive, stars)
    return links


def _cells(batches, width):
    """(id, cells): counts of each text's shingles by hash, saturating at 65535 for "any number"."""
    for rb in batches:
        cells = [np.minimum(np.bincount(shingle_set(t.as_py(), width) % np.uint64(CELLS), minlength=CELLS), 65535).astype(np.uint16) for t in rb.column(1)]
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], names=["id", "cells"])


def _group_pairs(g: dict[str, np.ndarray], least, batch, percent):
    """Pairs of one bucket's two blocks (or of one with itself) that the bounds and signatures let through."""
    left = np.flatnonzero(g["block"] == g["i"][0])
    same = g["i"][0] == g["j"][0]
    right = left if same else np.flatnonzero(g["block"] == g["j"][0])
    n, c, ids = g["n"], g["c"], g["id"]
    for lo in range(0, len(left), 64):  # 64 rows against the other block at a time
        u = left[lo : lo + 64]
        shared = np.minimum(c[u][:, None], c[right][None, :])
        ok = (g["label"][u][:, None] != g["label"][right][None, :]) & (100 * shared >= percent * (n[u][:, None] + n[right][None, :] - shared))
        if same:
            ok &= ids[u][:, None] < ids[right][None, :]
        x, y = np.nonzero(ok)
        x, y = u[x], right[y]
        matches = np.zeros(len(x), dtype=np.int64)
        for k, need in enumerate(least):
            part = slice(k * batch, (k + 1) * batch)
            matches += (g["sig"][x, part] == g["sig"][y, part]).sum(axis=1)
            stay = matches >= need
            x, y, matches = x[stay], y[stay], matches[stay]
        a, b = g["cells"][x], g["cells"][y]
        both = np.where((a == 65535) & (b == 65535), 1 << 40, np.minimum(a, b)).sum(axis=1)
        stay = 100 * both >= percent * (n[x] + n[y] - both)
        x, y = x[stay], y[stay]
        # A pair meets in several buckets; that of its first common band reports it.
        first = (g["bands"][x] == g["bands"][y]).argmax(axis=1)
        stay = g["bands"][x, first] == g["key"][0]
        yield np.minimum(ids[x[stay]], ids[y[stay]]), np.maximum(ids[x[stay]], ids[y[stay]])


def _pairs_by_group(batches, least, batch, percent):
    """Runs ``_group_pairs`` over rows sorted by (key, i, j); a group is two blocks of rows at most."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table):
        g = {k: table.column(k).to_numpy() for k in ("key", "i", "j", "block", "id", "label", "n", "c")}
        for k, kind in (("sig", np.uint16), ("cells", np.uint16)):
            g[k] = np.frombuffer(b"".join(table.column(k).to_pylist()), dtype=kind).reshape(len(table), -1)
        g["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        new = np.flatnonzero((np.diff(g["key"]) != 0) | (np.diff(g["i"]) != 0) | (np.diff(g["j"]) != 0)) + 1
        for lo, hi in zip(np.append(0, new), np.append(new, len(table))):
            if hi - lo > 1:
                for a, b in _group_pairs({k: v[lo:hi] for k, v in g.items()}, least, batch, percent):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for rb in batches:
        if not rb.num_rows:
            continue
        # The last group of a batch may go on in the next one.
        mark = [rb.column(k).to_numpy() for k in ("key", "i", "j")]
        last = np.flatnonzero((mark[0] != mark[0][-1]) | (mark[1] != mark[1][-1]) | (mark[2] != mark[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or held and any(held[-1].column(k)[-1].as_py() != m[0] for k, m in zip(("key", "i", "j"), mark)):
            yield from done(pa.Table.from_batches([*held, rb.slice(0, cut)]))
            held = []
        held.append(rb.slice(cut))
    if held:
        yield from done(pa.Table.from_batches(held))


def _rest(named, reps, pool, hot, least, batch, percent, width):
    """Candidates (a, b) across components, from all buckets that are still open."""
    g = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
    blocks = spread(g.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb")), hot, ["key"])
    cells = pool.join(named.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(lambda it: _cells(it, width), "id long, cells binary")
    # Members meet what is compared while they are one row a bucket; only then are they repeated for each block.
    rows = named.join(blocks, ["key", "salt"]).join(reps.select("id", "sig", "bands").join(cells, "id"), "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "label", "n", "c", "sig", "cells", "bands")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(lambda it: _pairs_by_group(it, least, batch, percent), "a long, b long")


def _reaches(shared, n, m, percent):
    """Whether sets of n and m members with at most ``shared`` in common can reach the threshold."""
    return 100 * shared >= percent * (n + m - shared)


def _shared(scratch, rows, reps):
    """(id, n, c) of the members of open buckets: c counts shingles that occur in two components or more."""
    seen = scratch.keep(rows.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")), "seen")
    hot = hot_keys(scratch, seen, ["s"])
    across = spread(seen.filter("x < y").select("s"), hot, ["s"])
    counted = salted(rows, hot, ["s"], F.col("id")).join(across, ["s", "salt"], "left_semi").groupBy("id").agg(F.count("*").alias("c"))
    out = rows.select("id").distinct().join(reps.select("id", "n"), "id").join(counted, "id", "left").select("id", "n", F.coalesce("c", F.lit(0)).alias("c"))
    out = scratch.keep(out, "shared")
    scratch.drop(seen, hot)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75, width: int = 5, miss: float = 1e-4, batch: int = 16, star_rounds: int = 2
) -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id, kept, text_hash, representative).

    Every row is a document of its own, linked by its own text: an id with several texts may be in several
    components.  ``component_id`` is the smallest id of a row that is reachable.  ``kept``: that this is the
    row's own id.  ``representative``: that the row has the id and text which stand for its component; repeated
    rows of that id and text all say so.  ``text_hash`` is xxhash64 of the text, to tell rows of one id apart.
    Null, empty and blank texts have no shingles and link with nothing.  Rows with a null id link nobody and
    come back with the component of an equal text, if any, kept = true and representative = true.  Empty
    input: empty output.  Other columns of ``docs`` are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.keep(src.mapInArrow(lambda it: _sketch(it, width), "id long, h long, n long, d1 long, d2 long, sig binary, bands array<long>"), "sketch")
    # Classes are numbered in the order of their smallest row; the number is what all later steps call id.
    least_row = sketch.filter("d1 is not null and id is not null").groupBy("d1", "d2").agg(F.min(F.struct("id", "h")).alias("low"))
    least_row = least_row.select("d1", "d2", F.col("low.id").alias("low"), F.col("low.h").alias("h")).orderBy("low", "h", "d1", "d2")
    classes = scratch.keep(least_row.withColumn("rep", F.monotonically_increasing_id()), "classes")
    known = classes.select(F.col("low").alias("id"), "h", "d1", "d2", "rep")
    reps = scratch.keep(
        sketch.join(known, ["id", "h", "d1", "d2"]).select(F.col("rep").alias("id"), "n", "sig", "bands").dropDuplicates(["id"]), "reps"
    )
    # What the result needs of all rows; the wide sketches go.
    members = scratch.keep(sketch.select("id", "h", "n", "d1", "d2"), "members")
    scratch.drop(sketch)
    rows = reps.select("id", F.explode("bands").alias("key"))
    busy = scratch.keep(rows.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).filter("c > 1"), "busy")
    hot = hot_keys(scratch, busy, ["key"])
    buckets = scratch.keep(salted(rows, hot, ["key"], F.col("id")).join(spread(busy.drop("c"), hot, ["key"]), ["key", "salt"]), "buckets")
    # The texts of all classes that share a bucket: one pass over the documents, read by every later step.
    named_rows = classes.join(buckets.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi").select(F.col("low").alias("id"), "h", "rep")
    pool = scratch.keep(src.join(named_rows, ["id", "h"]).select(F.col("rep").alias("id"), "text").dropDuplicates(["id"]), "pool")
    least = prune_table(CHECKED, batch, percent / 100, miss)
    sketches = reps.select("id", "n", "sig")
    verify = lambda pairs, prune=True: _verified(scratch, pairs, sketches if prune else None, pool, least, batch, percent, width)

    pairs = scratch.keep(buckets.filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = verify(pairs)
    labels = components(scratch, links, "a", "b")
    done = pairs
    for turn in range(2, star_rounds + 2):
        # Members by component; a bucket within one component is finished.
        named = scratch.keep(buckets.join(labels, "id", "left").select("key", "salt", "id", F.coalesce("label", "id").alias("label")), "named")
        several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
        open_ = scratch.keep(named.join(spread(several, hot, ["key"]), ["key", "salt"]), "open")
        scratch.drop(named)
        if open_.isEmpty():
            break
        rows = open_.select("id", "label").distinct().join(pool, "id").select("label", "id", "text")
        rows = scratch.keep(rows.mapInArrow(lambda it: _members(it, width), "label long, id long, s long"), "shingles")
        shared = _shared(scratch, rows, reps)
        scratch.drop(rows)
        # With fewer shared shingles than this a text reaches no other, whatever its bucket holds.
        able = shared.filter(_reaches(F.col("c"), F.col("n"), F.col("c"), percent))
        named = scratch.keep(open_.join(able, "id"), "counted")
        small = named.groupBy("key").agg(F.min("n").alias("least"))
        fits = _reaches(F.col("c"), F.col("n"), F.greatest("least", "c"), percent)
        reach = scratch.keep(named.join(spread(small, hot, ["key"]), ["key", "salt"]).filter(fits).drop("least"), "reach")
        if turn <= star_rounds:
            centre = reach.groupBy("key").agg(F.max(F.struct(F.col("c") / F.col("n"), -F.col("id"), "label", "n", "c")).alias("h"))
            centre = centre.select("key", (-F.col("h.col2")).alias("hub"), F.col("h.label").alias("hl"), F.col("h.n").alias("hn"), F.col("h.c").alias("hc"))
            met = reach.join(spread(centre, hot, ["key"]), ["key", "salt"])
            new = met.filter("label <> hl").filter(_reaches(F.least("c", "hc"), F.col("n"), F.col("hn"), percent))
            new = new.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        else:
            new = _rest(reach, reps, pool, hot, least, batch, percent, width)
        fresh = scratch.keep(new.distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        more = verify(fresh, turn <= star_rounds)
        links = labels.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(more)
        labels = components(scratch, links, "a", "b")
        scratch.drop(open_, named, reach, shared, more)
        done = done.unionByName(fresh)
    scratch.drop_all_but("members", "classes", "small")  # what the result still reads

    # A component's class is its label's; numbers grow with the smallest id, so that is its smallest id too.
    tops = classes.select(F.col("rep").alias("label"), F.col("low").alias("top"), F.col("h").alias("top_h"))
    own = classes.select("d1", "d2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    own = own.join(tops, "label").select("d1", "d2", "rep", "label", "top", "top_h")
    out = members.join(own, ["d1", "d2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("top", "id").alias("component_id"), F.col("h").alias("text_hash"),
        F.coalesce((F.col("rep") == F.col("label")) & (F.col("id") == F.col("top")) & (F.col("h") == F.col("top_h")), F.lit(True)).alias("representative"),
    )
    kept = F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    return out.select(id_col, "n_shingles", "component_id", kept.alias("kept"), "text_hash", "representative")
