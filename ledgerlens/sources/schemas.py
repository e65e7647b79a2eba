"""Schemas of the banking model.  Column names and types are fixed by the data."""

from __future__ import annotations

from pyspark.sql import types as T

_KIND = {"s": T.StringType(), "t": T.TimestampNTZType(), "l": T.LongType(), "d": T.DoubleType(), "i": T.IntegerType()}


def _schema(spec: str) -> T.StructType:
    pairs = [x.split(":") for x in spec.split()]
    return T.StructType([T.StructField(name, _KIND[kind], True) for name, kind in pairs])


# The tables' columns, in order.
SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        "customer_id:s date_of_birth:t relationship_start_date:t pan_available:s aadhaar_available:s passport_available:s"
        " mobile_banking_flag:s internet_banking_flag:s atm_card_flag:s demat_flag:s credit_card_flag:s fastag_flag:s"
        " customer_pin:l permanent_pin:l"
    ),
    "accounts": _schema(
        "account_id:s account_status:s product_code:l currency_code:l product_family:s branch_code:l branch_pin:l"
        " account_opening_date:t last_mobile_update_date:t last_kyc_date:t freeze_date:t unfreeze_date:t"
        " avg_balance:d monthly_avg_balance:d quarterly_avg_balance:d daily_avg_balance:d num_chequebooks:i"
        " nomination_flag:s cheque_allowed:s cheque_availed:s kyc_compliant:s rural_branch:s"
    ),
    "linkage": _schema("customer_id:s account_id:s"),
    "products": _schema(
        "customer_id:s loan_sum:d loan_count:l cc_sum:d cc_count:l od_sum:d od_count:l ka_sum:d ka_count:l sa_sum:d sa_count:l"
    ),
    "transactions": _schema(
        "transaction_id:s account_id:s transaction_timestamp:t amount:d txn_type:s channel:s mcc_code:i counterparty_id:s"
    ),
    "train_labels": _schema("account_id:s is_mule:i mule_flag_date:t alert_reason:s flagged_by_branch:s"),
    "test_accounts": _schema("account_id:s"),
}
