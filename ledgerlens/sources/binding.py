"""The banking model over the driver's tables, as DataFrames and as the same relations in SQL.

Binding T: order lines are transactions of customers (dates without hours).  Binding E: events are
transactions of users (microsecond times).  Nulls are put into some attributes on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn_t(spark: SparkSession, sf_dir: str, mcc: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """``labels`` = (account_id, more columns): they meet the orders, so that order lines go through one join less."""
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    more = [c for c in labels.columns if c != "account_id"] if labels is not None else []
    if labels is not None:
        orders = orders.join(labels, orders.o_custkey == labels.account_id, "left")
    df = line.join(orders, line.l_orderkey == orders.o_orderkey)
    if mcc:
        part = read(spark, sf_dir, "part")
        df = df.join(part.select("p_partkey", "p_size"), df.l_partkey == part.p_partkey)
    return df.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("l_shipdate").alias("transaction_timestamp"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "O", "C").otherwise("D").alias("txn_type"),
        F.concat("l_returnflag", "l_linestatus").alias("channel"),
        *([F.col("p_size").alias("mcc_code")] if mcc else []),
        F.col("l_suppkey").alias("counterparty_id"),
        *more,
    )


TXN_T = """txn AS (
  SELECT l_orderkey * 8 + l_linenumber AS transaction_id, o_custkey AS account_id, l_shipdate AS transaction_timestamp, l_extendedprice AS amount,
         CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'D' END AS txn_type, l_returnflag || l_linestatus AS channel,
         p_size AS mcc_code, l_suppkey AS counterparty_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def txn_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("transaction_timestamp"),
        F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("amount"),
        F.when(F.col("event_type") == "purchase", "C").otherwise("D").alias("txn_type"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("channel"),
        k.alias("mcc_code"),
        k.alias("counterparty_id"),
    )


TXN_E = """txn AS (
  SELECT event_id AS transaction_id, user_id AS account_id, ts AS transaction_timestamp,
         CASE WHEN event_id % 13 <> 0 THEN value END AS amount,
         CASE WHEN event_type = 'purchase' THEN 'C' ELSE 'D' END AS txn_type,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS channel,
         CAST(json_extract_string(props, '$.k') AS INT) AS mcc_code, CAST(json_extract_string(props, '$.k') AS INT) AS counterparty_id
  FROM events)"""


def accounts_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts from customers and the dates of their orders; attributes and nulls follow from the key."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    opened = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.min("o_orderdate").alias("account_opening_date"))
    yn = lambda n, y: F.when(k % n == y, "Y").when(k % n == (y + 1) % n, "N")
    bal = F.when(k % 7 != 0, F.col("c_acctbal"))
    base = c.select(
        k.alias("account_id"), F.col("c_nationkey").alias("branch_code"), F.col("c_mktsegment").alias("product_family"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("is_mule"),
        bal.alias("avg_balance"), (bal * 2).alias("monthly_avg_balance"), F.when(k % 14 != 1, bal / 2).alias("quarterly_avg_balance"), bal.alias("daily_avg_balance"),
        F.when(k % 4 == 0, "Frozen").otherwise("Active").alias("account_status"), yn(3, 0).alias("nomination_flag"), yn(5, 2).alias("kyc_compliant"),
        (100000 + F.col("c_nationkey") * 1000 + k % 7).alias("customer_pin"), F.when(k % 11 != 0, 100000 + (k % 25) * 1000 + k % 7).alias("permanent_pin"),
        F.when(k % 13 != 0, 100000 + F.col("c_nationkey") * 1000 + k % 5).alias("branch_pin"),
    )
    day = F.expr("INTERVAL 1 DAY")
    return base.join(opened, "account_id", "left").withColumns(
        {
            "last_mobile_update_date": F.when(F.col("account_id") % 5 == 0, F.col("account_opening_date") + day * 200),
            "freeze_date": F.when(F.col("account_id") % 4 == 0, F.col("account_opening_date") + day * 300),
            "unfreeze_date": F.when(F.col("account_id") % 8 == 0, F.col("account_opening_date") + day * 330),
        }
    )


ACCOUNTS_T = """opened AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1),
acct AS (
  SELECT c_custkey AS account_id, c_nationkey AS branch_code, c_mktsegment AS product_family,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_mule,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS avg_balance,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END * 2 AS monthly_avg_balance,
         CASE WHEN c_custkey % 14 <> 1 THEN CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END / 2 END AS quarterly_avg_balance,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS daily_avg_balance,
         CASE WHEN c_custkey % 4 = 0 THEN 'Frozen' ELSE 'Active' END AS account_status,
         CASE WHEN c_custkey % 3 = 0 THEN 'Y' WHEN c_custkey % 3 = 1 THEN 'N' END AS nomination_flag,
         CASE WHEN c_custkey % 5 = 2 THEN 'Y' WHEN c_custkey % 5 = 3 THEN 'N' END AS kyc_compliant,
         100000 + c_nationkey * 1000 + c_custkey % 7 AS customer_pin,
         CASE WHEN c_custkey % 11 <> 0 THEN 100000 + (c_custkey % 25) * 1000 + c_custkey % 7 END AS permanent_pin,
         CASE WHEN c_custkey % 13 <> 0 THEN 100000 + c_nationkey * 1000 + c_custkey % 5 END AS branch_pin,
         d AS account_opening_date,
         CASE WHEN c_custkey % 5 = 0 THEN d + INTERVAL 200 DAY END AS last_mobile_update_date,
         CASE WHEN c_custkey % 4 = 0 THEN d + INTERVAL 300 DAY END AS freeze_date,
         CASE WHEN c_custkey % 8 = 0 THEN d + INTERVAL 330 DAY END AS unfreeze_date
  FROM customer LEFT JOIN opened ON c_custkey = o_custkey)"""


# --- the whole banking model over the driver's tables, for the full feature table -----------------

_YN = "CASE WHEN k % {n} = {y} THEN 'Y' WHEN k % {n} = ({y} + 1) % {n} THEN 'N' END"


def _yn(n: int, y: int) -> str:
    return _YN.format(n=n, y=y)


#: Further attributes as SQL over the key ``k`` (both engines read them alike).
MORE_ACCOUNT = {
    "num_chequebooks": "CAST(k % 6 AS INT)", "product_code": "k % 9", "currency_code": "1 + k % 2", "cheque_allowed": _yn(4, 1), "cheque_availed": _yn(6, 2), "rural_branch": _yn(7, 3),
}
CUSTOMER = {
    "pan_available": _yn(3, 1), "aadhaar_available": _yn(4, 2), "passport_available": _yn(5, 0), "mobile_banking_flag": _yn(2, 0), "internet_banking_flag": _yn(3, 2), "atm_card_flag": _yn(4, 0),
    "demat_flag": _yn(5, 3), "credit_card_flag": _yn(6, 1), "fastag_flag": _yn(7, 5), "customer_pin": "100000 + k % 25 * 1000 + k % 7", "permanent_pin": "CASE WHEN k % 11 <> 0 THEN 100000 + k % 24 * 1000 + k % 7 END",
}
PRODUCT = {
    f"{p}_{what}": f"CASE WHEN k % {i + 2} = 0 THEN {value} END"
    for i, p in enumerate(("loan", "cc", "od", "ka", "sa")) for what, value in (("sum", f"CAST(k % 1000 AS DOUBLE) * {i + 1} / 2"), ("count", f"CAST(k % {i + 3} AS INT)"))
}
#: Which account belongs to which customer: two accounts each.
LINK = "CAST(floor((k + 1) / 2) AS BIGINT)"


def bank_t(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """transactions, accounts, customers, products and linkage of binding T."""
    key = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    with_k = lambda items: [F.expr(e).alias(n) for n, e in items.items()]
    days = lambda n: F.make_dt_interval(F.expr(n).cast("int"))
    more = key.select(F.col("k").alias("account_id"), *with_k(MORE_ACCOUNT))
    accounts = accounts_t(spark, sf_dir).join(more, "account_id").withColumn(
        "last_kyc_date", F.when(F.col("account_id") % 3 != 0, F.col("account_opening_date") + F.expr("INTERVAL 100 DAY"))
    )
    customers = key.select(
        F.col("k").alias("customer_id"), (F.expr("TIMESTAMP_NTZ '1950-01-01 00:00:00'") + days("k * 37 % 16000")).alias("date_of_birth"),
        F.when(F.col("k") % 9 != 0, F.expr("TIMESTAMP_NTZ '1990-01-01 00:00:00'") + days("k * 11 % 3000")).alias("relationship_start_date"), *with_k(CUSTOMER),
    )
    return {
        "transactions": txn_t(spark, sf_dir, True), "accounts": accounts, "customers": customers, "products": key.filter("k % 3 <> 1").select(F.col("k").alias("customer_id"), *with_k(PRODUCT)),
        "linkage": key.select(F.expr(LINK).alias("customer_id"), F.col("k").alias("account_id")),
    }


def _sql(items: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in items.items())


BANK_T = f"""{ACCOUNTS_T}, keys AS (SELECT c_custkey AS k FROM customer),
accounts AS (SELECT acct.*, m.* EXCLUDE (account_id), CASE WHEN acct.account_id % 3 <> 0 THEN account_opening_date + INTERVAL 100 DAY END AS last_kyc_date
  FROM acct JOIN (SELECT k AS account_id, {_sql(MORE_ACCOUNT)} FROM keys) m ON m.account_id = acct.account_id),
customers AS (SELECT k AS customer_id, TIMESTAMP '1950-01-01' + to_days(CAST(k * 37 % 16000 AS INT)) AS date_of_birth,
  CASE WHEN k % 9 <> 0 THEN TIMESTAMP '1990-01-01' + to_days(CAST(k * 11 % 3000 AS INT)) END AS relationship_start_date, {_sql(CUSTOMER)} FROM keys),
products AS (SELECT k AS customer_id, {_sql(PRODUCT)} FROM keys WHERE k % 3 <> 1),
linkage AS (SELECT {LINK} AS customer_id, k AS account_id FROM keys)"""
