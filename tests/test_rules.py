"""Null and edge rules on hand-made rows; expected values were worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.operators import features, models, profile, quality, stats, timeseries

TXN = "transaction_id long, account_id long, transaction_timestamp timestamp_ntz, amount double, txn_type string, channel string, mcc_code int, counterparty_id long"
T0 = dt.datetime(2024, 1, 1, 12)


def txns(spark, rows):
    """rows: dicts with what differs from a plain transaction."""
    base = {"account_id": 1, "transaction_timestamp": T0, "amount": 10.0, "txn_type": "C", "channel": "A", "mcc_code": 1, "counterparty_id": 1}
    names = ["transaction_id", *base]
    return spark.createDataFrame([tuple(({"transaction_id": i} | base | r)[n] for n in names) for i, r in enumerate(rows)], TXN)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_missing_balance_stays_missing_until_the_matrix(spark):
    df = spark.createDataFrame([(1, 100.0, 50.0, 3, None, 10)], "account_id long, total_amount double, max_amount double, txn_count long, avg_balance double, acct_age_days long")
    r = features.ratios(df)
    assert one(r).txn_to_balance_ratio is None
    assert one(features.matrix(r, ["txn_to_balance_ratio"])).txn_to_balance_ratio == 0.0


def test_null_amount_counts_in_the_base(spark):
    r = one(features.structuring(txns(spark, [{"amount": 47000.0}, {"amount": 10.0}, {"amount": None}])))
    assert r.near_50k_rate == pytest.approx(1 / 3)


def test_null_channel_is_not_in_the_base(spark):
    t = txns(spark, [{}, {}, {"channel": None}])
    assert one(features.category_rates(t, "channel", ["A"], "ch_", True)).ch_A_rate == 1.0
    assert one(features.category_rates(t, "channel", ["A"], "ch_", False)).ch_A_rate == pytest.approx(2 / 3)


def test_single_transaction(spark):
    t = txns(spark, [{}])
    assert one(features.basic_stats(t)).std_amount is None
    g = one(features.gaps(t))
    assert (g.med_gap_hrs, g.min_gap_hrs, g.std_gap_hrs, g.p10_gap_hrs) == (None,) * 4
    assert one(features.entropy(t, "channel", "e")).e == 0.0


def test_days_floor(spark):
    a, b = dt.datetime(2024, 1, 1, 22), dt.datetime(2024, 1, 2, 1)
    r = one(spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz").select(X.floor_days(F.col("b"), F.col("a")).alias("x"), X.floor_days(F.col("a"), F.col("b")).alias("y")))
    assert (r.x, r.y) == (0, -1)


def test_pin_mismatch(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, None)], "a long, b long")
    assert [r[0] for r in df.select(X.differs(F.col("a"), F.col("b")).cast("int")).collect()] == [0, 1, 1, 1]


def test_negative_amounts(spark):
    r = one(features.structuring(txns(spark, [{"amount": -500.0}])))
    assert (r.negative_rate, r.round_1k_rate) == (1.0, 0.0)
    assert one(features.structuring(txns(spark, [{"amount": -1000.0}]))).round_1k_rate == 1.0


def test_missing_credit_side(spark):
    r = one(features.flow(txns(spark, [{"txn_type": "D", "amount": 100.0}])))
    assert (r.credit_total, r.credit_mean, r.passthrough_ratio) == (0.0, None, 100.0)


def test_peak_tie_takes_the_earlier_day(spark):
    d = lambda k: {"transaction_timestamp": T0 + dt.timedelta(days=k)}
    t = txns(spark, [d(0), d(0), d(40), d(40)])
    r = timeseries.rolling(timeseries.dense_daily(t), 30, {"r": "n"})
    assert one(timeseries.peak_day(r, "r")).peak == T0.date()


def test_window_eligibility_and_order(spark):
    d = lambda k: {"transaction_timestamp": T0 + dt.timedelta(days=k)}
    assert timeseries.suspicious_windows(txns(spark, [d(0), d(0), d(1), d(1)])).count() == 0
    r = one(timeseries.suspicious_windows(txns(spark, [d(k) for k in (0, 100, 101, 102, 150, 400)])))
    assert (r.suspicious_start.date(), r.peak, r.suspicious_end.date()) == tuple((T0 + dt.timedelta(days=k)).date() for k in (100, 102, 150))


@pytest.mark.parametrize("cells,want", [([[10, 20], [30, 40]], 0.4464), ([[23275, 485], [158, 105]], 1542.46)])
def test_yates(spark, cells, want):
    rows = [(i, j, n) for i, r in enumerate(cells) for j, n in enumerate(r)]
    df = spark.createDataFrame(rows, "a int, b int, n int").select("a", "b", F.explode(F.sequence(F.lit(1), "n")))
    r = one(stats.chi_square(df, "a", "b"))
    assert r.chi2 == pytest.approx(want, abs=5e-3) and r.dof == 1
    if want > 1000:
        assert one(stats.chi_square(df, "a", "b", 24023)).cramers_v == pytest.approx(0.253, abs=5e-4)


def test_auc_of_ties_is_half(spark):
    assert one(stats.roc_auc(spark.createDataFrame([(0.5, 0), (0.5, 1)], "s double, y int"), "s", "y")).auc == 0.5


def test_label_codes(spark):
    df = spark.createDataFrame([(1, "Y"), (2, None), (3, "N")], "account_id long, f string")
    assert {r.account_id: r.f_enc for r in features.encode(df, "f").collect()} == {2: 0, 3: 1, 1: 2}


def test_row_spread_skips_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (5.0, None, None), (float("nan"), 2.0, 4.0)], "a double, b double, c double")
    got = df.select(X.row_std(*[F.col(c) for c in "abc"]).alias("s"), X.widest(*[F.col(c) for c in "abc"]).alias("w")).collect()
    assert [r.s for r in got] == [pytest.approx(math.sqrt(2)), None, pytest.approx(math.sqrt(2))]
    assert [r.w for r in got] == [2.0, 0.0, 2.0]


def test_leakage_and_null_profile(spark):
    df = spark.createDataFrame([(1, "x", 1), (0, None, 2), (0, None, None)], "y int, flagged string, other int")
    assert {r.column_name: r.leaks for r in quality.leakage_audit(df, "y").collect()} == {"flagged": 1, "other": 0}
    assert {r.column_name: r.n_null for r in quality.null_profile(df).collect()} == {"y": 0, "flagged": 2, "other": 1}


def test_published_costs(spark):
    rows = [(0.5, 1)] * 199 + [(0.1, 1)] * 64 + [(0.5, 0)] * 713 + [(0.1, 0)] * (23760 - 713)
    r = one(models.cost_sweep(spark.createDataFrame(rows, "s double, y int"), "s", "y", [0.32]))
    assert (r.cost, round(r.recall, 3), round(r.precision, 3), round(r.fpr, 3)) == (150_000, 0.757, 0.218, 0.03)


def test_p_values():
    assert stats.chi_square_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_p(0.27, 2) == pytest.approx(0.8737, abs=1e-4)
    assert stats.ks_p(100, 100, 0.1923) == pytest.approx(0.0495, abs=2e-3)
    assert stats.mann_whitney_p(10, 10, 50, 0) == pytest.approx(1.0, abs=0.05)


def test_bins_and_cut(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "v double")
    assert [r.bin for r in profile.equal_bins(df, "v", 2).orderBy("v").collect()] == [None, 0, 0, 1]
    assert [r[0] for r in df.select(profile.cut(F.col("v"), [0, 5, 10])).collect()] == [None, 0, 1, None]
    assert sum(r.n for r in profile.histogram(df, "v", 2).collect()) == 3


def test_report_rewrites(spark):
    from ledgerlens.operators import text

    md = "a\n*Table 1.2: old*\nb\n\n---\n\nc\n---\nd --- e"
    html = '<h2 class="x" id="table-of-contents">C</h2>\n<ul><li>1</li></ul><p><img src="a"/></p>\n<p><em>Figure 1.2: cap</em></p><p><img src="b"/></p><p><em>Table 2.1: t</em></p><p><em>other</em></p>'
    r = spark.createDataFrame([(md, html, "mobile_banking_flag")], "m string, h string, c string").select(
        text.drop_rules(F.col("m")).alias("m"), text.wrap_contents(text.captioned(F.col("h"))).alias("h"), text.column_title(F.col("c")).alias("c")
    ).first()
    assert r.m == "a\nb\n\nc\nd --- e"
    assert r.h == (
        '<div class="toc-page"><h2 class="x" id="table-of-contents">C</h2>\n<ul><li>1</li></ul></div><figure><img src="a"/><figcaption>Figure 1.2: cap</figcaption></figure>'
        '<figure><img src="b"/></figure><p class="table-caption">Table 2.1: t</p><p><em>other</em></p>'
    )
    assert r.c == "Mobile Banking"


def test_report_pages_with_attributes_nesting_and_strays(spark):
    from ledgerlens.operators import text

    cases = {
        '<p class="c" id="x">\n <img alt="1" src="a" width=3>\n</p> <p style="s"><em lang="en">Figure 10.2 : cap</em></p>z': '<figure><img alt="1" src="a" width=3><figcaption>Figure 10.2 : cap</figcaption></figure>z',
        '<p><em>Figure 1.1: alone</em></p><p><img src="a"/> text</p>': '<p><em>Figure 1.1: alone</em></p><p><img src="a"/> text</p>',
        '<p><img src="a"/></p>between<p><em>Figure 1.1: far</em></p>': '<figure><img src="a"/></figure>between<p><em>Figure 1.1: far</em></p>',
        '<p><img src="a"/><img src="b"/></p><p>open <b>p</b>': '<p><img src="a"/><img src="b"/></p><p>open <b>p</b>',
        '<pre>x</pre><p>q</p><p><em>Table 3: one number</em></p><p><em>Table 3.1: é😀</em></p>tail': '<pre>x</pre><p>q</p><p><em>Table 3: one number</em></p><p class="table-caption">Table 3.1: é😀</p>tail',
        '😀<h2 id="a">A</h2><h2 data-k="v" id="table-of-contents" class="q">C</h2> <ol class="t"><li>1<ul><li>2</li></ul></li><li>3</li></ol> rest <ul><li>n</li></ul>': (
            '😀<h2 id="a">A</h2><div class="toc-page"><h2 data-k="v" id="table-of-contents" class="q">C</h2> <ol class="t"><li>1<ul><li>2</li></ul></li><li>3</li></ol></div> rest <ul><li>n</li></ul>'
        ),
        '<h2 id="table-of-contents">C</h2><p>no list</p><ul><li>1</li></ul>': '<h2 id="table-of-contents">C</h2><p>no list</p><ul><li>1</li></ul>',
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "h string")
    assert {r.h: r.got for r in df.select("h", text.wrap_contents(text.captioned(F.col("h"))).alias("got")).collect()} == cases | {None: None}
    notes = {"*Table 1.2: first*\nx\n*Table 1: kept*": "x\n*Table 1: kept*", "\n---\n\n---\n\ny": "\ny", "---": "", "a\n\n---\nb": "a\n\nb", "**Table 1.1: bold**": "**Table 1.1: bold**"}
    df = spark.createDataFrame([(k,) for k in [*notes, None]], "m string")
    assert {r.m: r.got for r in df.select("m", text.drop_rules(F.col("m")).alias("got")).collect()} == notes | {None: None}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from ledgerlens.sources.shared import shared_dir

    def session(master, conf=None, own=None):
        made = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: own, setCheckpointDir=made.append)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf), sparkContext=sc), made

    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077")[0])
    assert shared_dir(session("spark://host:7077", "hdfs:///shared/")[0]) == "hdfs:///shared"
    assert shared_dir(session("yarn", None, "hdfs:///own")[0]) == "hdfs:///own"
    local, made = session("local[2]")
    assert shared_dir(local).startswith("file://") and len(made) == 1
