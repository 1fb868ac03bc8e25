"""Edge rules on a few rows each, with worked answers."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import consensus as C
from tidemark.operators import prices as P
from tidemark.operators import rows as R
from tidemark.operators import stats as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_transaction_types(spark):
    cases = {"P": "Purchase", "S (partial)": "Sale", "sold": "Sale", "Exchange": "Exchange", "buy and sell": None, "": None, None: None}
    for text, want in cases.items():
        assert one(spark, S.normalize_transaction_type(F.col("x")), text) == want, text


def test_dates(spark):
    cases = {"3/7/2024": dt.date(2024, 3, 7), "12/31/49": dt.date(2049, 12, 31), "1/2/50": dt.date(1950, 1, 2), "13/45/2024": None, "2/30/2023": None, "seen 2023-04-05": dt.date(2023, 4, 5), None: None}
    for text, want in cases.items():
        assert one(spark, S.parse_disclosure_date(F.col("x")), text) == want, text


def test_member_keys(spark):
    cases = {"José E. Serrano": "JOSE E SERRANO", "Neal Patrick Dunn MD, FACS": "NEAL PATRICK DUNN", "J. D. Vance": "JD VANCE", "N/A": "", None: "", "Dr. John Smith Jr.": "JOHN SMITH", "JD Vance": "JD VANCE"}
    for text, want in cases.items():
        assert one(spark, S.canonical_member_key(F.col("x")), text) == want, text


def test_cusips(spark):
    assert one(spark, S.cusip_is_valid(F.col("x")), "037833100")
    assert not one(spark, S.cusip_is_valid(F.col("x")), "037833101")
    assert not one(spark, S.cusip_is_valid(F.col("x")), "")


def test_calendar_leaves_out_holidays(spark):
    days = {r.session_date for r in P.exchange_sessions("2022-01-01", "2025-12-31", spark).collect()}
    closed = ["2022-01-17", "2022-04-15", "2022-06-20", "2022-12-26", "2023-01-02", "2023-04-07", "2024-03-29", "2024-07-04", "2024-11-28", "2025-01-09", "2025-06-19"]
    assert not days & {dt.date.fromisoformat(d) for d in closed}
    # New Year on a Saturday is not observed.
    assert {dt.date(2021, 12, 31)} <= {r.session_date for r in P.exchange_sessions("2021-12-30", "2021-12-31", spark).collect()}
    assert dt.date(2022, 6, 17) in days


def test_as_of_is_monotone(spark):
    rows = spark.createDataFrame([("d1", "AA", dt.date(2024, 1, 5), dt.date(2024, 1, 1)), ("d2", "AA", dt.date(2024, 2, 5), dt.date(2024, 1, 1)), ("d3", None, dt.date(2024, 1, 5), None), ("d4", "BB", None, None)], "doc string, ticker string, disclosure_date date, transaction_date date")
    day = F.lit("2024-01-31").cast("date")
    assert {r.doc for r in C.disclosure_window(rows, day).collect()} == {"d1"}
    assert {r.doc for r in C.as_of_cutoff(rows, day).collect()} == {"d1", "d3"}


def test_asof_quotes_and_ties(spark):
    prices = spark.createDataFrame([("A", dt.date(2024, 1, 2), 10.0), ("A", dt.date(2024, 1, 6), 11.0), ("A", dt.date(2024, 1, 4), -1.0)], "ticker string, date date, close double")
    keys = spark.createDataFrame([("A", dt.date(2024, 1, 4)), ("A", dt.date(2024, 1, 1)), ("B", dt.date(2024, 1, 4))], "ticker string, day date")
    back = {(r.ticker, r.day.day): r.quote for r in P.price_asof(keys, prices).collect()}
    assert back == {("A", 4): 10.0, ("A", 1): None, ("B", 4): None}
    near = {(r.ticker, r.day.day): r.quote for r in P.price_nearest(keys, prices, 2).collect()}
    assert near == {("A", 4): 10.0, ("A", 1): 10.0, ("B", 4): None}


def test_pooling_of_singletons_is_full(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "member string, x double")
    got = {r.member: r for r in T.partial_pooling(rows, "member", "x").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].shrinkage == 1.0 and got["a"].posterior_mean == 2.0 and got["a"].posterior_sd is None


def test_append_only_merge_matches_null_keys(spark):
    schema = "source string, chamber string, source_record_id string, source_row_id string, v int"
    old = spark.createDataFrame([("s", None, "1", "1", 1)], schema)
    new = spark.createDataFrame([("s", None, "1", "1", 2), ("s", "h", "1", "1", 3)], schema)
    assert sorted(r.v for r in R.merge_append_only(old, new).collect()) == [1, 3]
