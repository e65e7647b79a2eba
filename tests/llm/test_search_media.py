import gzip
import hashlib
import io
import os
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import imi, media, queries

DATA = os.environ.get("LEDGERLENS_TESTDATA", "/root/testdata")


def brute(vectors, is_query, k=20):
    """All inner products in double precision."""
    best, dim = {}, None
    for i, v in vectors:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = min(best.get(i, v), v)
    lens = [len(v) for v in best.values()]
    dim = max(sorted(set(lens)), key=lens.count) if lens else 0
    ids = sorted(i for i in best if len(best[i]) == dim)
    x = np.array([best[i] for i in ids], dtype=np.float64)
    out = {}
    for r, i in enumerate(ids):
        if is_query(i):
            s = np.einsum("ij,j->i", x, x[r])
            out[i] = sorted(((-s[j], ids[j]) for j in range(len(ids)) if j != r))[:k]
    return out


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    return np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in w}) / len(w) for q, w in want.items() if w])


@pytest.mark.parametrize("sf_dir", [f"{DATA}/sf0.001", f"{DATA}/sf0.1"])
def test_recall_on_embeddings(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    got = found(queries.op3_inverted_multi_index(spark, sf_dir))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9


def test_full_visit_is_exact_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("nan")] * 6), (405, [float("inf")] + [0.0] * 5), (406, [1.0, 2.0]), (None, [1.0] * 6), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit(1), "ids": F.lit("x")})
    got = found(imi.search(df, F.col("vec_id") % 5 == 0, visit=1.0, centroids=4, shard=40))
    want = brute(rows, lambda i: i % 5 == 0)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in got for (a, _), (b, _) in zip(got[q], want[q]))


def test_units_hold_whole_cells_and_split_large_ones():
    sizes = np.array([5, 0, 3, 40, 2, 9, 1])
    units = imi.Units(sizes, 10)
    total = np.bincount(units.group, weights=sizes)
    assert all(t <= 10 or np.sum((units.group == g) & (sizes > 0)) == 1 for g, t in enumerate(total))
    assert units.count.tolist() == [1, 4, 1, 1] and units.count[units.group[3]] == 4
    assert (np.diff(units.group) >= 0).all() and units.first.tolist() == (np.cumsum(units.count) - units.count).tolist()


def test_only_visited_cells_are_multiplied_and_sent(spark):
    """Clustered vectors: a small share of the entries finds nearly all neighbours, and a query meets few units."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 8
    x = np.concatenate([c + rng.normal(size=(50, 8)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(imi.search(df, F.col("vec_id") % 20 == 0, visit=0.1, centroids=16, shard=100))
    assert recall(got, brute([(i, v.tolist()) for i, v in enumerate(x)], lambda i: i % 20 == 0)) > 0.9
    c1, c2 = imi.kmeans(x[:, :4], 16), imi.kmeans(x[:, 4:], 16)
    cell = imi.nearest(x[:, :4], c1) * len(c2) + imi.nearest(x[:, 4:], c2)
    sizes = np.bincount(cell, minlength=len(c1) * len(c2))
    units = imi.Units(sizes, 100)
    import pyarrow as pa

    rb = pa.RecordBatch.from_arrays([pa.array(range(0, 2000, 20), pa.int64()), pa.array(x[::20].tolist(), pa.list_(pa.float64()))], names=["vec_id", "vec"])
    sent = pa.Table.from_batches(imi._dealt_queries([rb], c1, c2, 8, sizes, 200, units))
    cells = sent.column("cells").to_pylist()
    assert len(cells) < 100 * units.count.sum() / 2  # rows sent: far fewer than queries times units
    assert sum(int(sizes[c].sum()) for c in cells) < 100 * 2000 * 0.25  # products: visited entries only


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = found(imi.search(df, F.col("vec_id") % 20 == 0))
    assert [i for _, i in got[0]] == [1, 20] and [i for _, i in got[20]] == [1, 0]
    assert imi.search(df.filter("false"), F.lit(True)).count() == 0


def png(data=b"\0" * 4):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def bmp():
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x11\xff\x00\x22\xff\xd0\x33\xff\xd9"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 50)
    return out.getvalue()


def riff(form, *chunks):
    body = form + b"".join(t + struct.pack("<I", len(d)) + d + b"\0" * (len(d) & 1) for t, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(tag, data):
    return struct.pack(">I", 8 + len(data)) + tag + data


SAMPLES = {
    "image/png": png(), "image/gif": gif(), "image/bmp": bmp(), "image/jpeg": jpeg(), "audio/wav": media.to_wav(b"abcd" * 16), "application/zip": archive(),
    "application/gzip": gzip.compress(b"x" * 500), "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF",
    "image/webp": riff(b"WEBP", (b"VP8L", b"\x2f" * 9)), "video/x-msvideo": riff(b"AVI ", (b"LIST", b"hdrl" + b"a" * 8), (b"idx1", b"q" * 6)),
    "video/mp4": box(b"ftyp", b"isom" * 3) + box(b"moov", b"m" * 40) + box(b"mdat", b"d" * 100),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_formats(kind):
    data = SAMPLES[kind]
    assert media.find_media(data) == [(0, len(data), kind)]
    assert (7, len(data), kind) in media.find_media(b"prefix " + data + b" suffix ")
    assert kind not in [k for _, n, k in media.find_media(data[:-3]) if n == len(data)]
    assert all(k != kind or n < len(data) for _, n, k in media.find_media(data[: len(data) // 2]))


def test_pdf_goes_on_to_its_last_end_mark():
    one = SAMPLES["application/pdf"] + b"\r\n"
    update = one + b"2 0 obj\n<< >>\nendobj\nxref\n0 0\nstartxref\n60\n%%EOF\n"
    holder = b"%PDF-1.7\n1 0 obj\nstream\n" + one + b"endstream\nendobj\nstartxref\n9\n%%EOF\n"
    for data in (one, update, holder):
        assert media.find_media(data) == [(0, len(data), "application/pdf")]
        assert media.find_media(data + png() + data) == [(0, len(data), "application/pdf"), (len(data), len(png()), "image/png"), (len(data) + len(png()), len(data), "application/pdf")]
        assert media.find_media(data + data) == [(0, len(data), "application/pdf"), (len(data), len(data), "application/pdf")]


def test_linearized_pdf_is_whole():
    """Two end marks: that of the first page's section, with objects after it, and the file's own."""
    data = b"%PDF-1.5\n1 0 obj\n<< /Linearized 1 >>\nendobj\nxref\n0 1\ntrailer\nstartxref\n0\n%%EOF\n7 0 obj\n<< >>\nendobj\nxref\n0 1\nstartxref\n116\n%%EOF\n"
    assert media.find_media(data) == [(0, len(data), "application/pdf")]
    assert media.find_media(b"%PDF-1.5 no end") == media.find_media(b"%PDF-1.5 %%EOF") == []


def test_zip64():
    plain = archive()
    end = plain.index(b"PK\x05\x06")
    size, start = struct.unpack_from("<II", plain, end + 12)
    n = struct.unpack_from("<H", plain, end + 10)[0]
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start)
    data = plain[:end] + record + b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert media.find_media(b"xx" + data + b"yy") == [(2, len(data), "application/zip")]


@pytest.mark.parametrize("magic", [*media.MAGIC, b"RIFF\0\0\0\0WAVE", b"%PDF-%%EOF", b"%PDF-startxref%%EOF 1 0 obj ", b"PK\x03\x04PK\x05\x06", b"GIF89a\0\0\0\0\0\0\0!\xff\x05", b"\xff\xd8\xff\xda\0\2", b"\x1f\x8b\x08\x08abcdefgh"])
def test_payloads_full_of_signatures_are_linear(magic):
    import time

    def seconds(n):
        data = magic * (n // len(magic))
        since = time.process_time()
        media.find_media(data)
        return time.process_time() - since

    small, large = seconds(500_000), seconds(4_000_000)
    assert large < 40 * max(small, 0.02), (magic, small, large)  # eight times the bytes; the square would be 64


def test_carving_by_brute_force():
    """Every offset is tried by each validator, without the automaton."""
    rng = random.Random(4)
    parts = list(SAMPLES.values()) + [b"BM", b"GIF89a", b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff", b"plain text", b"RIFF", b"\0" * 9, b"ftyp", b"%%EOF", b"startxref"]
    for _ in range(60):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))
        want, end = [], 0
        for at in range(len(data)):
            if at < end:
                continue
            for magic, (kind, lead) in media.MAGIC.items():
                if data[at + lead : at + lead + len(magic)] == magic:
                    stop = media.VALID[kind](media.Payload(data), at)  # nothing kept from earlier walks
                    if stop is not None:
                        want.append((at, stop - at, media.RIFF[data[at + 8 : at + 12]][0] if kind == "riff" else kind))
                        end = stop
                        break
        assert media.find_media(data) == want


def test_feature_by_brute_force(spark):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(0, 300)))) for i in range(30)] + [(50, "GIF89a" + "x" * 70), (51, None)]
    got = {r.doc_id: r.feature for r in media.read_texts(media.store_texts(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        raw += b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(raw, raw[1:]))
        assert got[i] == f"audio/wav;rate=8000;n={len(raw)};sum={sum(raw)};crossings={crossings};media=0"


def test_declared_types_are_corrected_one_by_one(spark):
    kinds = list(SAMPLES)
    rows = [(i * 20 + j, SAMPLES[a], b) for i, a in enumerate(kinds) for j, b in enumerate([*kinds, None, "text/plain"])]
    got = media.sniff(spark.createDataFrame(rows, "k long, payload binary, declared string"), "k", "payload", "declared").collect()
    assert len(got) == len(rows)
    for r in got:
        real = kinds[r.k // 20]
        assert (r.detected, r.corrected) == (real, r.declared != real)


def test_sniff_corrects_and_carves(spark):
    rows = [(1, SAMPLES["image/png"], "image/jpeg"), (2, SAMPLES["image/gif"], "image/gif"), (3, b"RIFF BM GIF89a plain", "text/plain"), (4, None, None), (5, b"", "x"), (6, b"ab" + png() + gif(), None)]
    got = {r.k: r for r in media.sniff(spark.createDataFrame(rows, "k long, payload binary, declared string"), "k", "payload", "declared").collect()}
    assert (got[1].detected, got[1].corrected, got[2].corrected) == ("image/png", True, False)
    assert got[3].detected == got[4].detected == got[5].detected == media.UNKNOWN and not got[3].media
    assert [(m.start, m.type) for m in got[6].media] == [(2, "image/png"), (2 + len(png()), "image/gif")]


def test_media_query_and_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    odd = {-1: None, -2: "", -3: "a" * 64, -4: "é" * 70000, -5: "RIFF GIF89a \0 BM", -6: "".join(random.Random(1).choice("ab\n") for _ in range(65))}
    df = spark.createDataFrame(list(odd.items()), "doc_id long, text string").withColumn("media", F.lit(1))
    rows = queries.op7_media_columns(spark, sf).collect() + media.read_texts(media.store_texts(df)).collect()
    assert len(rows) == len(texts) + len(odd)
    for r in rows:
        raw = ({**texts, **odd}[r.doc_id] or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(want), zlib.crc32(want[-64:]))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest()
        assert (r.media_bytes, r.media_sha256) == (len(media.to_wav(want)), hashlib.sha256(media.to_wav(want)).hexdigest())
    assert media.read_texts(media.store_texts(df.filter("false"))).count() == 0
