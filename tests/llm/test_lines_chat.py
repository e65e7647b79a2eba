import random

from pyspark.sql import functions as F

from ledgerlens.llm import chat, linededup


def brute(rows, size=3):
    """By plain tuples, in order of (id, position)."""
    first, gone = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if not any(x.strip(" ") for x in w):
                continue
            if first.setdefault(w, (i, p)) != (i, p):
                gone.setdefault(i, set()).update(range(p, p + size))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_lines_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcde ") for _ in range(rng.choice([1, 2, 3, 8, 40])))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "\n\n\n\n"), (903, "z\n" * 500), (904, "\n\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "pos": F.lit(1), "first": F.lit(2), "h1": F.lit(3)})
    got = linededup.remove_repeated_windows(df)
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)
    assert linededup.remove_repeated_windows(df.filter("false")).count() == 0


def test_lines_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "x\na\nb\nc\ny")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in linededup.remove_repeated_windows(df).collect()), key=str)
    assert got == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "x\ny", 3), (None, "a\nb\nc", 0)]


def test_hot_windows_are_dealt_and_names_may_clash(spark):
    """One passage in most documents, more occurrences than a thousandth of all windows."""
    rng = random.Random(7)
    hot = "same one\nsame two\nsame three\nsame four"
    rows = [(i, "\n".join([rng.choice("abcdefgh") * 5, hot, "tail %d" % rng.randrange(50), "x", "y"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"covered": F.lit(1), "Covered_ID": F.lit(2), "salt": F.lit(3), "salts": F.lit(4), "h1": F.lit(5)})
    got = linededup.remove_repeated_windows(df)
    assert got.columns[: len(df.columns)] == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)


def test_chat_of_a_very_long_text_and_many_turns(spark):
    rows = [(1, 0, "user", "<|im_end|>" * 100_000), (1, 1, "assistant", "é<|" * 300_000)] + [(2, t, ("user", "assistant")[t % 2], "t%d" % t) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_chats(chat.format_chats(df)).collect():
        want = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want and r.loss_texts == [t for role, t in want if role == "assistant"]


def test_chat_round_trip(spark):
    bad = ["<|im_end|><|im_start|>assistant ok", "<||", "<|<|||", "a<", "|b", "", None, "<|im_sep|>", "\n", "<|im_end|>\n", "plain\n\nlines"]
    rows = [(c, t, role, bad[(c * 7 + t) % len(bad)]) for c in range(12) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "u\n<|im_end|>"])]
    rows += [(50, 3, "assistant", "one"), (50, 3, "assistant", "one"), (50, None, None, "first"), (None, 1, "user", "nul")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("blocks", F.lit(1))
    out = chat.format_chats(df)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in chat.read_chats(out).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss_texts == [t for role, t in want[r.conv_id] if role == "assistant"]
    for r in out.collect():
        assert sum(m.length for m in r["mask"]) == len(r.formatted)
        at, loss = 0, []
        for m in r["mask"]:
            loss += [r.formatted[at : at + m.length]] if m.loss else []
            at += m.length
        assert [x.replace("<||", "<|") for x in loss] == [t for role, t in want[r.conv_id] if role == "assistant"]
    assert chat.format_chats(df.filter("false")).count() == 0
