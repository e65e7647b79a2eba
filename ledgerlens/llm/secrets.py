"""Secret scans with DataFrame functions only.

Base patterns find assignments, access keys and long hex runs.  A randomness test battery adds tokens that
no test tells from uniform draws over their inferred alphabet:

* chi-squared of the symbol counts against uniformity (Wilson-Hilferty normal form);
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* lag-1 serial correlation of the symbols' places in the alphabet.

A token's p-value is three times the least of the three, at most 1, which holds under any dependence.
Short tokens give little power, so false discoveries are controlled both ways per stratum of alphabet and
length (powers of two).  Benjamini-Hochberg at rate ``q`` rejects "random" for ordinary strings, bounding the
share of real secrets among what is dismissed.  What it does not reject is reported only up to the p-value
down to which reports exceed the random tokens that are to be expected by no more than the share ``false``:
random tokens have even p-values, so their number is estimated from the upper half (Storey).  P-values are
counted in bins of a hundredth of a decade, so all of this comes from one small table of counts over all
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are taken whole, so 20 characters can be asked for in the pattern
HEX = r"[0-9a-f]{24,}"
#: A whole run of token characters, tried at the start of each run only: 20 with a digit, or 32 without one.  Of
#: shorter runs of letters the battery cannot tell words from random draws.  20 random characters of 62 have no
#: digit in 3.0 % of cases, 31 in 0.4 %: that is what is lost.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+|[A-Za-z0-9+/_=-]{32,}+)"
KINDS = ("assign", "access", "hex", "random")
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    ("letters", r"\A[a-z]+\z", _LOW),
    ("LETTERS", r"\A[A-Z]+\z", _UP),
    ("alpha", r"\A[A-Za-z]+\z", _UP + _LOW),
    ("hex", r"\A[0-9a-f]+\z", _DIG + "abcdef"),
    ("HEX", r"\A[0-9A-F]+\z", _DIG + "ABCDEF"),
    ("lower", r"\A[a-z0-9]+\z", _LOW + _DIG),
    ("upper", r"\A[A-Z0-9]+\z", _UP + _DIG),
    ("alnum", r"\A[A-Za-z0-9]+\z", _UP + _LOW + _DIG),
    ("base64", r"\A[A-Za-z0-9+/]+\z", _UP + _LOW + _DIG + "+/"),
    ("url64", r"\A[A-Za-z0-9_-]+\z", _UP + _LOW + _DIG + "-_"),
)
MIXED = ("mixed", _UP + _LOW + _DIG + "+/-_")
BINS = 3000
HALF = 30  # the level of p = 0.5


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"
CHUNK = 256


def _places(text: Column, pattern: str, kind: int) -> Column:
    """Structs (start, kind, end, text) of all matches: lengths of the parts between them, summed up.

    Running sums are taken over chunks of matches: first each chunk's length, then where chunks start,
    then the places within each.  Appending to an array copies it, so no array is appended to more than
    some hundred times for a text of ten thousand matches.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    parts = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))

    def chunked(all_parts: Column) -> Column:
        n = F.ceil(F.size(all_parts) / CHUNK).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda k: F.slice(all_parts, k * CHUNK + 1, F.lit(CHUNK)))

    def length(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda a, x: a + F.length(x["b"]) + F.length(x["m"]))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        item = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], item).alias("out"))

    def placed(chunks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        firsts = F.aggregate(
            F.transform(chunks, length), zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"]
        )
        within = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda a: a["out"])
        return F.flatten(F.zip_with(chunks, firsts, within))

    return _let(parts, lambda p: _let(chunked(p), placed))


def _count_below(spans: Column, start: Column) -> Column:
    """How many of ``spans``, sorted by start, start before ``start``: bisection by falling powers of two."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), lambda p: p <= F.size(spans))
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.get(spans, n + p - 1)["start"] < start, n + p).otherwise(n))


def _maybe(text: Column, pattern: str, value: Column) -> Column:
    """The costly expression only where the pattern occurs at all."""
    none = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), value).otherwise(none)


#: Coefficients of a Chebyshev fit to the complementary error function, whose relative error is
#: under 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution."""

    def at(x: Column) -> Column:
        t = 1.0 / (1.0 + 0.5 * F.abs(x))
        poly = F.lit(ERFC[-1])
        for c in ERFC[-2::-1]:
            poly = F.lit(c) + t * poly
        half = 0.5 * t * F.exp(-x * x + poly)
        return F.when(x >= 0, half).otherwise(1.0 - half)

    return _let(F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0)) / F.lit(2**0.5), at)


def _alphabet(token: Column) -> tuple[Column, Column]:
    core = F.rtrim(token, F.lit("="))
    name, letters = F.lit(MIXED[0]), F.lit(MIXED[1])
    for n, pattern, chars in reversed(ALPHABETS):
        hit = core.rlike(pattern)
        name, letters = F.when(hit, n).otherwise(name), F.when(hit, chars).otherwise(letters)
    return name, letters


def _battery(x: Column, s: Column, squares: Column) -> Column:
    """The combined p-value.  x: (core, letters); s: one pass over the symbols' places, see ``_sums``."""
    n, k = F.length(x["core"]).cast("double"), F.length(x["letters"]).cast("double")
    chi, df = squares * k / n - n, k - 1
    wh = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = _tail(wh)
    mu = 2 * s["up"] * (n - s["up"]) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    p_runs = F.when(var > 0, 2 * _tail(F.abs(s["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(2.0**-20)
    mean = s["s1"] / n
    spread = s["s2"] - n * mean * mean
    cross = s["c"] - mean * (2 * s["s1"] - s["x0"] - s["prev"]) + (n - 1) * mean * mean
    p_serial = F.when(spread > 0, 2 * _tail(F.abs(cross / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(2.0**-20)
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def _sums(x: Column) -> Column:
    """Sums over the symbols' places in the alphabet, in one pass: (x0, prev, s1, s2, c, up, runs)."""
    mid = (F.length(x["letters"]) - 1) / 2.0
    place = lambda c: F.instr(x["letters"], c).cast("double") - 1

    def made(x0, prev, s1, s2, c, up, runs):
        return F.struct(*[v.alias(k) for k, v in {"x0": x0, "prev": prev, "s1": s1, "s2": s2, "c": c, "up": up, "runs": runs}.items()])

    def step(acc: Column, ch: Column) -> Column:
        def add(v):
            crossed = F.when((v > mid) != (acc["prev"] > mid), 1.0).otherwise(0.0)
            new = acc["runs"] == 0
            return made(
                F.when(new, v).otherwise(acc["x0"]), v, acc["s1"] + v, acc["s2"] + v * v,
                acc["c"] + F.when(new, 0.0).otherwise(acc["prev"] * v), acc["up"] + F.when(v > mid, 1.0).otherwise(0.0),
                F.when(new, 1.0).otherwise(acc["runs"] + crossed),
            )

        return _let(place(ch), add)

    return F.aggregate(F.split(x["core"], ""), made(*[F.lit(0.0)] * 7), step)


def _judged(token: Column) -> Column:
    """A candidate's (stratum, level): its alphabet and length class, and -100 log10 p."""

    def known(x: Column) -> Column:
        stratum = F.concat(x["name"], F.lit(":"), F.floor(F.log2(F.greatest(F.length(x["core"]), F.lit(2)))).cast("string"))
        squares = F.aggregate(
            F.transform(F.split(x["letters"], ""), lambda c: F.length(x["core"]) - F.length(F.replace(x["core"], c, F.lit("")))),
            F.lit(0.0), lambda a, c: a + c.cast("double") * c,
        )
        p = _let(_sums(x), lambda s: _battery(x, s, squares))
        level = F.least(F.lit(BINS), F.floor(-100 * F.log10(F.greatest(p, F.lit(1e-30)))).cast("int"))
        return F.struct(token["start"].alias("start"), token["kind"].alias("kind"), token["end"].alias("end"), stratum.alias("stratum"), level.alias("level"))

    name, letters = _alphabet(token["text"])
    return _let(F.struct(F.rtrim(token["text"], F.lit("=")).alias("core"), name.alias("name"), letters.alias("letters")), known)


def _long_enough(t: Column) -> Column:
    core = F.rtrim(t["text"], F.lit("="))
    return F.length(core) >= F.when(core.rlike("[0-9]"), 20).otherwise(32)


def _candidates(text: Column) -> Column:
    return F.transform(_maybe(text, TOKEN, F.filter(_places(text, TOKEN, 3), _long_enough)), _judged)


def _levels(docs: DataFrame, text_col: str) -> DataFrame:
    """(stratum, level, n): how many tokens have which p-value, over all texts."""
    level = docs.select(F.explode(_candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("c"))
    return level.groupBy("c.stratum", "c.level").agg(F.count(F.lit(1)).alias("n"))


def _ranked(levels: DataFrame, q: float, false: float) -> DataFrame:
    """``levels`` with what is reported up to each of them, and how much of it is random; ``cut`` for the whole stratum."""
    down = Window.partitionBy("stratum").orderBy(F.desc("level"))
    up = Window.partitionBy("stratum").orderBy("level")
    whole = Window.partitionBy("stratum")
    p = lambda c: F.pow(F.lit(10.0), -c / 100.0)
    # Random tokens by the share of p-values above a half; one more, so that a lone token can be reported.
    random = 2 * (F.coalesce(F.sum(F.when(F.col("level") < HALF, F.col("n"))).over(whole), F.lit(0)) + 1)
    ranked = levels.select(
        "stratum", "level", F.sum("n").over(down).alias("below"), F.sum("n").over(whole).alias("all"), F.sum("n").over(up).alias("upto"), random.alias("random")
    )
    rejected = p(F.col("level")) <= F.lit(q) * F.col("below") / F.col("all")
    expected = F.col("random") * (1 - p(F.col("level") + 1))
    ranked = ranked.withColumns({"rejected": rejected, "expected": expected, "fits": F.col("upto") * (1 - F.lit(false)) <= F.greatest(expected, F.lit(1.0))})
    bh = F.min(F.when(F.col("rejected"), F.col("level"))).over(whole)
    most = F.max(F.when(F.col("fits"), F.col("level") + 1)).over(whole)
    return ranked.withColumn("cut", F.least(F.coalesce(bh, F.lit(BINS + 1)), F.coalesce(most, F.lit(0))))


def _cuts(levels: DataFrame, q: float, false: float) -> DataFrame:
    """(stratum, cut, reported, expected): levels under ``cut`` are reported; ``expected`` of them are random."""
    under = F.col("level") < F.col("cut")
    return _ranked(levels, q, false).groupBy("stratum", "cut").agg(
        F.coalesce(F.max(F.when(under, F.col("upto"))), F.lit(0)).alias("reported"), F.coalesce(F.max(F.when(under, F.col("expected"))), F.lit(0.0)).alias("expected")
    )


def stratum_report(docs: DataFrame, text_col: str = "text", *, q: float = 0.05, false: float = 0.1) -> DataFrame:
    """(stratum, cut, reported, expected, false_share): what is reported by alphabet and length class, and the
    share of it that the estimate does not account for as random."""
    got = _cuts(_levels(docs, text_col), q, false)
    share = F.when(F.col("reported") > 0, F.greatest(F.lit(0.0), 1 - F.col("expected") / F.col("reported")))
    return got.withColumn("false_share", share)


def thresholds(docs: DataFrame, text_col: str, q: float, false: float = 0.1) -> dict[str, int]:
    """For each stratum the bin from which on tokens are dismissed.  At most a few hundred entries: 11 alphabets
    by the powers of two that a text's length can reach."""
    return {r.stratum: r.cut for r in _cuts(_levels(docs, text_col), q, false).select("stratum", "cut").collect()}


def find_secrets(docs: DataFrame, text_col: str = "text", *, q: float = 0.05, false: float = 0.1, out_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out_col``: (start, kind, end) structs sorted by start, then kind.

    kind: 0 assign, 1 access, 2 hex, 3 random; start and end in code points, end exclusive.  A random
    token that lies in a base span is not listed again.  Null and empty texts: no spans.  Repeated rows
    are judged alike (each counts in the thresholds).  ``out_col`` replaces a column of that name; all
    others pass through, whatever their names.  Works on whole texts of any length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = thresholds(docs, text_col, q, false)
    flat = [F.lit(x) for pair in sorted(least.items()) for x in pair]
    cut = F.create_map(*flat) if flat else F.create_map().cast("map<string,int>")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    # Both sides are computed once; inside the lambda either would be evaluated anew for every match.
    assign = _let(F.struct(_places(text, ASSIGN, 0).alias("at"), values.alias("of")), lambda m: F.filter(m["at"], lambda t, i: F.length(F.get(m["of"], i)) >= 6))
    bare = lambda spans: F.transform(spans, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    found = (_maybe(text, ASSIGN, assign), _maybe(text, ACCESS, _places(text, ACCESS, 1)), _maybe(text, HEX, _places(text, HEX, 2)))
    c_base, c_cand = [fresh(docs, f"{k}_spans") for k in KINDS[:3]], fresh(docs, "candidates")
    got = docs.withColumns({**{c: bare(spans) for c, spans in zip(c_base, found)}, c_cand: _candidates(text)})

    def inside(c: Column, kind: str) -> Column:
        """Spans of a kind do not overlap, so only the last that starts no later than ``c`` can hold it."""
        last = F.get(F.col(kind), _count_below(F.col(kind), c["start"] + 1) - 1)
        return F.coalesce(last["end"] >= c["end"], F.lit(False))

    least_level = lambda c: F.coalesce(F.element_at(cut, c["stratum"]), F.lit(1 << 30))
    random = F.filter(c_cand, lambda c: (c["level"] < least_level(c)) & ~inside(c, c_base[0]) & ~inside(c, c_base[1]) & ~inside(c, c_base[2]))
    return got.withColumn(out_col, F.array_sort(F.concat(*c_base, bare(random)))).drop(*c_base, c_cand)


STRETCH = 2048


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by ``mark``; overlapping spans give one mark.

    ``spans_col`` is sorted by start, as ``find_secrets`` gives it.  Rows without spans keep their text as it
    is, null included.  The text is taken in stretches of STRETCH code points, each with the spans that start in
    it, so a text of many spans costs in proportion to its length.
    """
    text, spans = F.col(text_col), F.col(spans_col)
    stretches = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STRETCH), F.lit(0))

    def state(at, out):
        return F.struct(at.alias("at"), out.alias("out"))

    def stretch(chunk: Column, first: Column, at0: Column, own: Column) -> Column:
        """(at, out): the chunk that begins at ``first`` rewritten; ``at0``: up to where earlier spans reach."""
        cut = lambda lo, hi: F.substring(chunk, lo - first + 1, F.greatest(hi - lo, F.lit(0)))

        def step(acc: Column, s: Column) -> Column:
            gap = F.concat(cut(acc["at"], s["start"]), F.lit(mark))
            return state(F.greatest(acc["at"], s["end"]), F.concat(acc["out"], F.when(s["start"] >= acc["at"], gap).otherwise("")))

        end = first + F.length(chunk)
        return F.aggregate(own, state(F.greatest(at0, first), F.lit("")), step, lambda a: state(a["at"], F.concat(a["out"], cut(a["at"], end))))

    def all_of(chunks: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            lo, hi = _count_below(spans, i * STRETCH), _count_below(spans, (i + 1) * STRETCH)
            done = stretch(F.get(chunks, i), i * STRETCH, acc["at"], F.slice(spans, lo + 1, hi - lo))
            return _let(done, lambda d: state(d["at"], F.array_append(acc["out"], d["out"])))

        return F.aggregate(F.sequence(F.lit(0), F.size(chunks) - 1), state(F.lit(0), F.array().cast("array<string>")), step, lambda a: F.array_join(a["out"], ""))

    return docs.withColumn(text_col, F.when((F.size(spans) > 0) & (F.length(text) > 0), _let(stretches, all_of)).otherwise(text))


def kind_name(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), kind)


__all__ = ["find_secrets", "redact", "thresholds", "kind_name", "KINDS"]
