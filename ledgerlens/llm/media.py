"""Media columns: container signatures found by Aho-Corasick, confirmed by walking the format's structure.

``sniff`` corrects declared types and carves media embedded anywhere in a payload.  ``to_wav`` stores bytes
losslessly as 8-bit PCM samples.

Validators never copy the rest of a payload.  What they look for far ahead (end marks, the next zero byte or
marker) is found once per payload and kept, so a payload full of signatures costs in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: The magic bytes of each format, and how many bytes of the file stand before them.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("riff", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"ftyp": ("video/mp4", 4),
}
#: RIFF forms with the chunks that must be there, and boxes that may follow one another in MP4.
RIFF = {b"WAVE": ("audio/wav", {b"fmt ", b"data"}), b"AVI ": ("video/x-msvideo", {b"LIST"}), b"WEBP": ("image/webp", set())}
WEBP = {b"VP8 ", b"VP8L", b"VP8X"}
BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"udta", b"uuid", b"styp", b"sidx", b"meta", b"pdin"}
UNKNOWN = "application/octet-stream"


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, (kind, lead) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic) + lead, kind))
    a.make_automaton()
    return a


#: A JPEG marker in entropy-coded data: not a stuffed byte, a restart or a fill byte.
_JPEG_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
#: What follows the end mark of a part that is not the last: linearized and updated files, and embedded ones.
_PDF_GOES_ON = re.compile(rb"\s{0,64}(?:\d{1,10}\s{1,8}\d{1,10}\s{1,8}obj|xref|startxref|endstream)\b")


class Payload:
    """Bytes with what is looked up ahead: next places, PDF end marks and ZIP end records."""

    def __init__(self, raw: bytes):
        self.raw, self.view, self.n = raw, memoryview(raw), len(raw)
        self.ahead: dict[object, tuple[int, int]] = {}
        self.dead: set[int] = set()  # where a walk over GIF blocks came to nothing

    def next(self, what, p: int) -> int:
        """The first place of ``what`` (bytes or a pattern) from p on, -1 if none; kept while it lies ahead."""
        since, at = self.ahead.get(what, (0, -2))
        if at == -2 or p < since or 0 <= at < p:
            if isinstance(what, bytes):
                at = self.raw.find(what, p)
            else:
                m = what.search(self.raw, p)
                at = m.start() if m else -1
            self.ahead[what] = (p, at)
        return at

    @cached_property
    def pdf_ends(self):
        """(places of %%EOF, last startxref before each, the last good end from each one on or -1)."""
        eofs = [m.start() for m in re.finditer(rb"%%EOF", self.raw)]
        refs = [m.start() for m in re.finditer(rb"startxref", self.raw)]
        before = [refs[i - 1] if (i := bisect_left(refs, e)) else -1 for e in eofs]
        best, after = [-1] * len(eofs), [False] * len(eofs)
        for k in range(len(eofs) - 1, -1, -1):
            after[k] = k + 1 < len(eofs) and bool(_PDF_GOES_ON.match(self.raw, eofs[k] + 5))
            good = before[k] > (eofs[k - 1] if k else -1)
            best[k] = best[k + 1] if after[k] and best[k + 1] >= 0 else eofs[k] + 5 if good else -1
        return eofs, before, best, after

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Start of an archive -> its end, by the end records: their sizes tell where the archive begins."""
        out: dict[int, int] = {}
        for m in re.finditer(rb"PK\x05\x06", self.raw):
            p = m.start()
            if p + 22 > self.n:
                continue
            size, start, note = struct.unpack_from("<IIH", self.raw, p + 12)
            end, at = p + 22 + note, p - size - start
            big = p - 76  # a 64-bit end record and its locator stand before the plain one
            if 0xFFFFFFFF in (size, start) and big >= 0 and self.raw[big : big + 4] == b"PK\x06\x06" and self.raw[p - 20 : p - 16] == b"PK\x06\x07":
                size, start = struct.unpack_from("<QQ", self.raw, big + 40)
                at = big - size - start
            if at >= 0 and end <= self.n:
                out.setdefault(at, end)
        return out


def _png(f: Payload, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= f.n:
        n, tag = struct.unpack_from(">I4s", f.raw, p)
        if p + 12 + n > f.n or first and (tag != b"IHDR" or n != 13) or not tag.isalpha():
            return None
        if zlib.crc32(f.view[p + 4 : p + 8 + n]) != struct.unpack_from(">I", f.raw, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if tag == b"IEND":
            return p
    return None


def _jpeg(f: Payload, at: int) -> int | None:
    b, p, scanned = f.raw, at + 2, False
    while p + 4 <= f.n or scanned and p + 2 <= f.n:
        if b[p] != 0xFF:
            return None
        m = b[p + 1]
        if m == 0xFF:
            p += 1
            continue
        if m == 0xD9 and scanned:
            return p + 2
        # Markers without a length cannot stand here: another start, an end before any scan, restarts.
        if m < 0xC0 or 0xD0 <= m <= 0xD9 or p + 4 > f.n:
            return None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > f.n:
            return None
        p += 2 + n
        if m == 0xDA:  # entropy-coded data up to the next real marker
            p, scanned = f.next(_JPEG_MARK, p), True
            if p < 0:
                return None
    return None


def _gif(f: Payload, at: int) -> int | None:
    if at + 13 > f.n:
        return None
    b, flags = f.raw, f.raw[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    passed = []
    while p < f.n and p not in f.dead:
        passed.append(p)
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < f.n:
            local = b[p + 9]
            p += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            break
        while p < f.n and b[p] and -p not in f.dead:  # sub-blocks
            passed.append(-p)
            p += 1 + b[p]
        if p >= f.n or b[p]:
            break
        p += 1
    f.dead.update(passed)
    return None


def _bmp(f: Payload, at: int) -> int | None:
    if at + 26 > f.n:
        return None
    size, spare, data, head = struct.unpack_from("<IIII", f.raw, at + 2)
    ok = spare == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= data <= size and at + size <= f.n
    return at + size if ok else None


def _riff(f: Payload, at: int) -> int | None:
    form = f.raw[at + 8 : at + 12]
    if form not in RIFF:
        return None
    end = at + 8 + struct.unpack_from("<I", f.raw, at + 4)[0]
    p, seen = at + 12, set()
    if end > f.n:
        return None
    while p + 8 <= end:
        tag, n = struct.unpack_from("<4sI", f.raw, p)
        if p + 8 + n > end or tag == b"fmt " and n < 16:
            return None
        seen.add(tag)
        p += 8 + n + (n & 1)
    return end if RIFF[form][1] <= seen and (form != b"WEBP" or WEBP & seen) and p >= end else None


def _pdf(f: Payload, at: int) -> int | None:
    """Up to the last end mark of the file: past those of linearized and updated files' parts, with its line ends."""
    eofs, before, best, after = f.pdf_ends
    k = bisect_left(eofs, at)
    if k == len(eofs):
        return None
    end = best[k + 1] if after[k] and best[k + 1] >= 0 else eofs[k] + 5 if before[k] > at else None
    while end is not None and f.raw[end : end + 1] in (b"\r", b"\n"):
        end += 1
    return end


def _zip(f: Payload, at: int) -> int | None:
    return f.zip_ends.get(at)


def _gzip(f: Payload, at: int) -> int | None:
    """The header by hand, for a name without an end would be sought through the whole payload; then zlib."""
    if at + 18 > f.n or f.raw[at + 3] & 0xE0:
        return None
    flags, p = f.raw[at + 3], at + 10
    if flags & 4:
        p += 2 + struct.unpack_from("<H", f.raw, p)[0]
    for bit in (8, 16):  # name, comment
        if flags & bit:
            p = f.next(b"\0", p) + 1
            if p == 0:
                return None
    if p + (2 if flags & 2 else 0) + 8 > f.n:
        return None
    d, q, step = zlib.decompressobj(31), at, 512
    q = p if p - at > 65536 else at  # a long name is not fed again: raw data then
    if q == p:
        d, q = zlib.decompressobj(-15), p + (2 if flags & 2 else 0)
    raw_mode, crc, size = q != at, 0, 0
    try:
        while q < f.n and not d.eof:
            left = f.view[q : q + step]
            q += len(left)
            while len(left) and not d.eof:
                out = d.decompress(left, 1 << 16)
                if raw_mode:
                    crc, size = zlib.crc32(out, crc), size + len(out)
                left = d.unconsumed_tail
            step = 65536
    except zlib.error:
        return None
    if not d.eof:
        return None
    end = q - len(d.unused_data)
    if raw_mode:
        if end + 8 > f.n or struct.unpack_from("<II", f.raw, end) != (crc, size & 0xFFFFFFFF):
            return None
        end += 8
    return end


def _mp4(f: Payload, at: int) -> int | None:
    p, seen = at, set()
    while p + 8 <= f.n:
        n, tag = struct.unpack_from(">I4s", f.raw, p)
        if tag not in BOXES or tag == b"ftyp" and p != at:
            break
        if n == 1 and p + 16 <= f.n:
            n = struct.unpack_from(">Q", f.raw, p + 8)[0]
        elif n == 0:
            n = f.n - p
        if n < 8 or p + n > f.n:
            return None
        p += n
        seen.add(tag)
    return p if b"moov" in seen and p > at else None


VALID = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff,
    "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4,
}


def find_media(data: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of all confirmed media, in order; what lies inside another one is part of it."""
    found, out, end = Payload(data), [], 0
    for last, (n, kind) in automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at < end:
            continue
        stop = VALID[kind](found, at)
        if stop is not None:
            out.append((at, stop - at, RIFF[data[at + 8 : at + 12]][0] if kind == "riff" else kind))
            end = stop
    return out


SNIFFED = "detected string, corrected boolean, media array<struct<start:long,length:long,type:string>>"


def _sniff(batches):
    for rb in batches:
        names = rb.schema.names
        found = [find_media(x) if x else [] for x in rb.column(names.index("payload")).to_pylist()]
        sizes = [len(x) if x else 0 for x in rb.column(names.index("payload")).to_pylist()]
        types = [f[0][2] if f and f[0][0] == 0 and f[0][1] == n else UNKNOWN for f, n in zip(found, sizes)]
        told = rb.column(names.index("declared")).to_pylist()
        media = pa.array(
            [[{"start": s, "length": n, "type": t} for s, n, t in f] for f in found],
            pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())])),
        )
        yield pa.RecordBatch.from_arrays(
            [*rb.columns, pa.array(types, pa.string()), pa.array([a != b for a, b in zip(told, types)], pa.bool_()), media], names=[*names, "detected", "corrected", "media"]
        )


def sniff(df: DataFrame, id_col: str, payload_col: str, declared_col: str) -> DataFrame:
    """(id_col, payload, declared, detected, corrected, media) of each row.

    ``detected`` is the type whose structure spans the whole payload, else application/octet-stream;
    ``corrected`` tells that it differs from the declared one (null counts as different); ``media`` lists
    what can be carved: start, length and type.  Null and empty payloads: nothing found.
    """
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload"), F.col(declared_col).cast("string").alias("declared"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(_sniff, f"id {kind}, payload binary, declared string, {SNIFFED}")
    return out.withColumnRenamed("id", id_col)


RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM; payloads of even length need no pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + (len(payload) & 1), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(data):
        tag, n = struct.unpack_from("<4sI", data, p)
        if tag == b"data":
            return data[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _store(batches):
    for rb in batches:
        out, size = [], []
        for t in rb.column(1).to_pylist():
            raw = (t or "").encode("utf-8", "surrogatepass")
            size.append(len(raw))
            out.append(to_wav(raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))))
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(size, pa.int64()), pa.array(out, pa.large_binary()).cast(pa.binary())], names=["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a WAV file.

    Null texts count as empty.  Repeated rows give repeated rows.  Only the two columns are read.
    """
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_store, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def feature(samples: bytes, found: list, kind: str) -> str:
    """Type, rate, length, mean, zero crossings about the middle, and what else was carved, as text."""
    x = np.frombuffer(samples, dtype=np.uint8)
    up = x >= 128
    return f"{kind};rate={RATE};n={len(x)};sum={int(x.sum(dtype=np.int64))};crossings={int((up[1:] != up[:-1]).sum())};media={len(found)}"


def _read(batches):
    for rb in batches:
        rows = {k: rb.column(rb.schema.names.index(k)).to_pylist() for k in ("payload", "detected", "media")}
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data, kind, found in zip(*rows.values()):
            if kind != "audio/wav":
                raise ValueError(f"a stored text reads back as {kind}")
            samples = wav_samples(data)
            inner = find_media(samples)
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-64:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(feature(samples, [m for m in found if m["start"]] + inner, kind))
        keep = [rb.schema.names.index("id"), rb.schema.names.index("n_bytes")]
        cols = [pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) if v else pa.array([], pa.string() if "sha" in k or k == "feature" else pa.int64()) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([*[rb.column(k) for k in keep], *cols], names=["id", "n_bytes", *out])


def read_texts(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of media columns made by ``store_texts``: the type is sniffed from the bytes (they
    are declared as octet streams), corrected, and the samples are read back from the file's own structure."""
    key = F.struct(F.col(id_col).alias("id"), "n_bytes").alias("key")
    seen = sniff(stored.select(key, "media", F.lit(UNKNOWN).alias("declared")), "key", "media", "declared")
    flat = seen.select(F.col("key.id").alias("id"), F.col("key.n_bytes").alias("n_bytes"), "payload", "detected", "media")
    kind = flat.schema["id"].dataType.simpleString()
    out = flat.mapInArrow(
        _read, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out.withColumnRenamed("id", id_col)
