import base64
import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, packing, pretok, queries

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
HARD = [
    "", " ", "  ", "a", "don't stop 'llama we'll they've I'd 'tis ''s 'S", "x's's'll've'rex", " 's  's\n's", "tab\t\tword \n\n next  ", "!!'s '' 's' a''s",
    "é😀 ñandú 漢字かな １２３ ½ x²", "a b  c　　d", "1234 5,678.90 a1b2", "́combining é", "\x1c\x1d \x85 z", "end  ", "\n", "'", "'r", "'re", "<|endoftext|> x",
    "word" * 300, "ab " * 500, "'''''", "\0 \0\0x", "𝒜𝒷 ᾳ ⅷ ٣", "I'M we'LL 'd'd",
]


def fuzz(n=400):
    rng = random.Random(4)
    signs = ["'", "s", "t", "re", "ll", "ve", "m", "d", " ", "  ", "\n", "\t", "é", "1", "22", "!", "?!", "漢", " ", "x", "Word", "\0"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(n)]


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_match_the_pattern():
    texts = HARD + fuzz()
    own, counts, at = pretok.pieces(texts)
    k = 0
    for t, n in zip(texts, counts):
        want = [(m[0], m.start()) for m in regex.finditer(P.PATTERN, t)]
        if "\x1c" not in t:
            assert list(zip(own[k : k + n], at[k : k + n])) == want, repr(t)
        k += n
    assert k == len(own)


def test_merge_short_and_long():
    ranks, enc, rng = bpe.read_ranks(P.path(RANKS)), tiktoken_encoding(), random.Random(1)
    for n in (1, 5, 40, 119, 121, 300, 2000):
        piece = "".join(rng.choice("abcdethinger") for _ in range(n))
        assert bpe.merge(piece.encode(), ranks) == bpe._merge_long(piece.encode(), ranks) == enc.encode_ordinary(piece)


def test_encode_decode_query(spark, sf):
    enc = tiktoken_encoding()
    rows = [(i, t, 1) for i, t in enumerate(HARD + fuzz(100) + [None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, P.path(RANKS)), P.path(RANKS)).collect()
    for r in got:
        text = rows[r.doc_id][1] or ""
        assert r.ids == enc.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode(df.filter("false"), P.path(RANKS)).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_bpe_codec(spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_offsets_place_tokens_and_stretches(spark):
    enc = tiktoken_encoding()
    rows = [(i, t) for i, t in enumerate(HARD + fuzz(60) + [None, "", "é😀漢字 " * 3000])]
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), P.path(RANKS))
    for r in coded.collect():
        at = 0
        for i, o in zip(r.ids, r.offsets):
            assert o == at
            at += len(enc.decode_single_token_bytes(i))
        assert at == len((rows[r.doc_id][1] or "").encode())
    for a, b in ((0, 5), (3, 4), (7, 7), (9, 2), (2, 10**9), (10**9, 10**9 + 1), (1, None)):
        part = bpe.decode(coded, P.path(RANKS), start=F.lit(a), end=F.lit(b)).collect()
        for r in part:
            raw = (rows[r.doc_id][1] or "").encode()
            assert bytes(r.decoded) == raw[a : len(raw) if b is None else max(a, b)], (a, b, r.doc_id)
    nulls = spark.createDataFrame([(1, None, None), (2, [], [])], "doc_id long, ids array<int>, offsets array<int>")
    assert [(r.doc_id, r.decoded) for r in bpe.decode(nulls, P.path(RANKS)).collect()] == [(1, None), (2, b"")]
    for bad in ([(1, [10**6], [0])], [(1, [5, 6], [0, 9])]):
        with pytest.raises(Exception, match="rank file|do not fit"):
            bpe.decode(spark.createDataFrame(bad, "doc_id long, ids array<int>, offsets array<int>"), P.path(RANKS)).collect()


def test_cache_is_bounded_in_characters():
    ranks = bpe.read_ranks(P.path(RANKS))

    def encode_new(new):
        got = [bpe.merge(p.encode(), ranks) for p in new]
        return np.arange(len(new)), np.array([i for g in got for i in g], dtype=np.int32), np.array([len(g) for g in got])

    table = bpe.PieceTable(encode_new, chars=500)
    for turn in range(10):
        words = [chr(97 + turn) * (200 + k) for k in range(3)]
        flat, _ = table.ids(words, np.arange(3))
        assert flat.tolist() == [i for w in words for i in bpe.merge(w.encode(), ranks)]
        assert table.at.chars <= 500 + 3 * 203


def test_grouped_encoding_equals_single(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(JSON))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + HARD + [" ñandú 漢字かな ᾳxyz héé αβγ", " é ́a"]
    own = list(dict.fromkeys(pretok.pieces(texts)[0]))
    order, flat, sizes = packing._Encoder(t)(own)
    ends = sizes.cumsum()
    got = {int(k): flat[e - n : e].tolist() for k, e, n in zip(order, ends, sizes)}
    assert got == {k: t.encode(p, add_special_tokens=False).ids for k, p in enumerate(own)}


def test_distinct_pieces_stand_for_all():
    texts = HARD + fuzz() + ["", "a b a b a b"]
    own, which, counts, at = pretok.distinct_pieces(texts)
    plain, plain_counts, plain_at = pretok.pieces(texts)
    assert [own[k] for k in which] == plain and len(set(own)) == len(own)
    assert (counts == plain_counts).all() and (at == plain_at).all()
    assert pretok.distinct_pieces(["", ""])[0] == []


def test_cache_keeps_what_is_used():
    ranks = bpe.read_ranks(P.path(RANKS))

    def encode_new(new):
        got = [bpe.merge(p.encode(), ranks) for p in new]
        return np.arange(len(new)), np.array([i for g in got for i in g], dtype=np.int32), np.array([len(g) for g in got])

    table = bpe.PieceTable(encode_new, most=50)
    for turn in range(20):
        words = [f" w{turn}x{k}" for k in range(30)] + [" the", " and"] * 3
        own = list(dict.fromkeys(words))
        flat, size = table.ids(own, np.array([own.index(w) for w in words]))
        assert flat.tolist() == [i for w in words for i in bpe.merge(w.encode(), ranks)] and size.sum() == len(flat)
        assert len(table.at) <= 50 + 32
    assert " the" in table.at


def test_assign_fills_sequences():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 1024) for _ in range(rng.randrange(1, 200))]
        room = rng.choice([0, 0, 300])
        placed, _ = packing.assign(sizes, 1024, room, 1024 - room if room else 0, 100.0)
        by_doc, by_seq = {}, {}
        for d, start, n, k, at in placed:
            by_doc.setdefault(d, []).append((start, n))
            by_seq.setdefault(k, []).append((at, n))
        for d, parts in by_doc.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == sizes[d]
        for k, parts in by_seq.items():
            at = 1024 - room if k == 0 else 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at <= 1024
        assert 1024 * len([k for k in by_seq if k]) < sum(sizes) + 1024


def test_assign_takes_the_cheapest_sequence_with_room():
    """Step by step: the longest document left goes to the sequence of least cost among all that have room."""
    rng = random.Random(12)
    for _ in range(25):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
        room, linear, quadratic = rng.choice([0, 17]), 1.0, rng.choice([0.0, 1 / 64, 0.5])
        got, _ = packing.assign(sizes, 64, room, 64 - room if room else 0, 33.0, linear, quadratic)
        rooms = {0: room} | {k: 64 for k in range(1, 1 + max(0, -(-(sum(sizes) - room) // 64)))}
        spent = {k: 33.0 if k == 0 else 0.0 for k in rooms}
        want = []
        for d in sorted(range(len(sizes)), key=lambda d: (-sizes[d], d)):
            at = 0
            while at < sizes[d]:
                k = min((k for k in rooms if rooms[k] > 0), key=lambda k: (spent[k], k))
                n = min(sizes[d] - at, rooms[k])
                want.append((d, at, n, k, 64 - rooms[k]))
                rooms[k] -= n
                spent[k] += linear * n + quadratic * n * n
                at += n
        assert got == want


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(JSON))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "dup"), (-3, "dup"), (-4, "long text " * 6000)], "doc_id long, text string")
    rows = packing.pack(docs.unionByName(extra).repartition(2), P.path(JSON), block_docs=50).collect()
    texts = {r.doc_id: r.text or "" for r in docs.unionByName(extra).collect()}
    whole, seqs = {}, {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length > 0
    for i, text in texts.items():
        want = t.encode(text, add_special_tokens=False).ids + [0]
        parts = sorted(whole[i], key=lambda r: r.start)
        if i != -3:
            assert [x for r in parts for x in r.ids] == want
            assert [r.start for r in parts] == [sum(r.length for r in parts[:k]) for k in range(len(parts))]
        assert all(r.doc_tokens == len(want) for r in parts)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    tokens = sum(r.length for r in rows)
    assert 1024 * len(seqs) < tokens + 1024 * 12
    assert packing.pack(docs.filter("false"), P.path(JSON)).count() == 0
