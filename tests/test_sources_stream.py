import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import features, text
from ledgerlens.sources import binding, io
from ledgerlens.sources.schemas import SCHEMAS
from ledgerlens.streaming import twins


def write(path, header, *rows):
    path.write_text("\n".join([header, *rows]) + "\n")


def bank(folder, n=12):
    """A small bank in CSV files, transactions in two parts, some bad dates."""
    names = {k: ",".join(s.names) for k, s in SCHEMAS.items()}
    write(folder / "customers.csv", names["customers"], *[f"C{i},1980-01-0{i % 9 + 1},not a date,Y,,N,Y,Y,N,N,Y,N,11000{i},{'' if i % 3 == 0 else 110000}" for i in range(n)])
    write(folder / "accounts.csv", names["accounts"], *[f"A{i},{'Frozen' if i % 4 == 0 else 'Active'},{i % 3},356,SAV,{i % 5},,2020-01-01,,2021-05-01,{'2022-01-01' if i % 4 == 0 else ''},,{'' if i == 1 else 100 + i},{i},{i},{i},2,Y,N,,Y,N" for i in range(n)])
    write(folder / "linkage.csv", names["linkage"], *[f"C{i},A{i}" for i in range(n)])
    write(folder / "products.csv", names["products"], *[f"C{i},,,{i}.5,1,,,,,10,2" for i in range(n)])
    rows = [f"T{i}-{k},A{i},2024-01-{k + 1:02d} 0{k % 9}:00:00,{100 * (k + 1)},{'C' if k % 2 else 'D'},{['UPC', 'ATW', ''][k % 3]},{[6011, 5411][k % 2]},P{k % 3}" for i in range(n - 1) for k in range(6)]
    write(folder / "transactions_part_0.csv", names["transactions"], *rows[: len(rows) // 2])
    write(folder / "transactions_part_1.csv", names["transactions"], *rows[len(rows) // 2 :])
    write(folder / "train_labels.csv", names["train_labels"], *[f"A{i},{int(i % 4 == 0)},,," for i in range(n)])
    write(folder / "test_accounts.csv", names["test_accounts"], "A1")


def test_csv_tables_to_122_features(spark, tmp_path):
    bank(tmp_path)
    t = io.load(spark, str(tmp_path))
    assert t["transactions"].count() == 66 and dict(t["transactions"].dtypes)["transaction_timestamp"] == "timestamp_ntz"
    assert t["customers"].filter("relationship_start_date is null").count() == 12
    out = features.build(t["transactions"], t["accounts"], t["customers"], t["products"], t["linkage"])
    names = [c for c in out.columns if c != "account_id"]
    assert len(names) == len(set(names)) == 122
    rows = {r.account_id: r for r in out.collect()}
    assert len(rows) == 11  # the account without a transaction has no features
    assert rows["A1"].txn_to_balance_ratio is None and rows["A2"].txn_to_balance_ratio == 2100 / 102
    assert rows["A4"].account_status_enc == 1 and rows["A5"].account_status_enc == 0
    assert rows["A3"].pin_mismatch == 1 and rows["A3"].kyc_score == 1 and rows["A3"].cc_count == 1 and rows["A3"].loan_sum is None
    assert rows["A2"].ch_UPC_rate == 0.5 and rows["A2"].n_channels_used == 2 and rows["A2"].mcc_6011_rate == 0.5
    lean = features.build(t["transactions"], t["accounts"], t["customers"], t["products"], t["linkage"], leakage_free=True)
    assert not set(features.LEAKING) & set(lean.columns)


def test_csv_round_trip(spark, tmp_path):
    io.write_csv(spark.range(3).withColumn("x", F.lit("a")), str(tmp_path / "out"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    assert io.concat(spark.range(2), spark.range(1).withColumn("y", F.lit(1))).count() == 3


def test_streams_equal_batch(spark, sf, tmp_path):
    batch = binding.txn_e(spark, sf)
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: twins.source(spark, str(tmp_path / "in"), batch.schema, files_per_trigger=10)
    got = twins.drain(twins.tumbling_counts(stream()), "daily_counts", str(tmp_path / "c1"))
    want = batch.groupBy("account_id", F.to_date("transaction_timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))
    assert sorted(map(str, got.select("account_id", "day", "n", "total").collect())) == sorted(map(str, want.collect()))
    gaps = twins.drain(twins.running_gaps(stream()), "gaps", str(tmp_path / "c2"), "update")
    want = {r.account_id: r.min_gap_hrs for r in features.gaps(batch).collect()}
    assert {r.account_id: r.min_gap_hrs for r in gaps.collect()}.keys() == want.keys()
    assert all(abs(r.min_gap_hrs - want[r.account_id]) < 1e-6 for r in gaps.collect() if r.min_gap_hrs is not None)
    once = twins.drain(twins.distinct_transactions(stream().union(stream())), "once", str(tmp_path / "c3"), "append")
    assert once.count() == batch.count()
    assert twins.drain(twins.bursts(stream()), "bursts", str(tmp_path / "c4"), "append").count() >= 0
    assert twins.drain(twins.sliding_counts(stream(), size="2 days"), "sliding", str(tmp_path / "c5")).agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_upsert_keeps_the_newest(spark, tmp_path):
    keep = twins.upsert(str(tmp_path / "t"), ["k"])
    keep(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), 0)
    keep(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_text_operators(spark):
    lines = ["## 1 A", "x", "| a |", "| b |", "", "| c |", "```", "| no |", "```", "## 2 B", "| d |"]
    df = spark.createDataFrame([(7, i, s) for i, s in enumerate(lines)], "doc_id long, line_no int, line string")
    assert sorted((r.line_no, r.section, r.table_no) for r in text.numbered_tables(df).collect()) == [(2, 1, 1), (5, 1, 2), (10, 2, 1)]
    r = spark.createDataFrame([('**Table 1.2: x**\nrest <img alt="q" src="p/a.PNG"> <img src=\'b.svg\'>', "a.jpg", b"hi")], "t string, p string, b binary")
    got = r.select(text.strip_captions(F.col("t")).alias("s"), text.image_names(F.col("t")).alias("i"), text.data_uri(F.col("p"), F.col("b")).alias("u")).first()
    assert got.s.startswith("rest") and got.i == ["p/a.PNG", "b.svg"] and got.u == "data:image/jpeg;base64,aGk="


def test_predictions(spark):
    s = spark.createDataFrame([(1, 0.9), (2, 0.1)], "account_id long, score double")
    w = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 3))], "account_id long, suspicious_start timestamp_ntz, suspicious_end timestamp_ntz")
    assert sorted(tuple(r) for r in io.predictions(s, w).collect()) == [(1, 0.9, "2024-01-02T00:00:00", "2024-02-03T00:00:00"), (2, 0.1, "", "")]


def test_bad_rows_are_kept_aside(spark, tmp_path):
    schema = twins.T._parse_datatype_string("id long, v double, at timestamp_ntz")
    write(tmp_path / "a.csv", "id,v,at", "1,2.5,2024-01-01 00:00:00", "2,x,2024-01-01", "3,1", "4,1,2024-02-30", "5,,", "6,1,2024-01-01,7")
    write(tmp_path / "b.csv", "id,v,at", "7,0,2024-03-01", "8,1,yesterday")
    good, bad = io.checked_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schema, str(tmp_path / "bad"))
    assert sorted((r.id, r.v, r["at"] and r["at"].month) for r in good.collect()) == [(1, 2.5, 1), (5, None, None), (7, 0.0, 3)]
    assert good.select("id").count() == 3  # also when only one column is asked for
    assert sorted((r.reason, r.record) for r in bad.collect()) == [
        ("columns", "2,x,2024-01-01"), ("columns", "3,1"), ("columns", "6,1,2024-01-01,7"), ("time", "4,1,2024-02-30"), ("time", "8,1,yesterday")
    ]
    (tmp_path / "none").mkdir()
    write(tmp_path / "none" / "c.csv", "id,v,at")
    good, bad = io.checked_csv(spark, str(tmp_path / "none" / "c.csv"), schema)
    assert good.count() == 0 == bad.count()
