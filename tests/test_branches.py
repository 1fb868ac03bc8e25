"""Single rows for the branches of rules that the large queries mix."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as N
from tidemark.operators import cohorts, fills, identities, portfolio, prices, setups
from tidemark.operators.stats import cohort_summary

DAY = dt.date(2024, 5, 1)


def values(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


def test_company_names(spark):
    texts = ["Johnson & Johnson", "Acme Holdings Limited", "Banco NV", "ZOETIS INC CMN CLASS A", "Company", "Visa Inc. Common Stock", "Acme Group Class D", "A&B Co", None]
    assert values(spark, N.normalize_company_name, texts) == ["JOHNSON AND JOHNSON", "ACME", "BANCO NV", "ZOETIS", "COMPANY", "VISA", "ACME GROUP CLASS D", "A AND B CO", ""]


@pytest.mark.parametrize("most_names", [200_000, 0])
def test_companies_in_texts(spark, most_names):
    companies = spark.createDataFrame([("APPLE", "AAPL"), ("APPLE HOSPITALITY REIT", "APLE"), ("ACME", "AC1"), ("ACME", "AC2"), ("MICROSOFT", "MSFT"), ("GENERAL ELECTRIC", "GE")], "name string, symbol string")
    want = {
        "Apple Inc [ACCOUNT: Cash Fund]": "AAPL", "Apple Inc (custodian = Bond Trust)": "AAPL", "Apple Hospitality REIT, Inc.": "APLE", "Apple and Microsoft": None, "Acme Holdings Inc. Class A": None, "Gene Elec": "GE", "Gen Electric": None, "US Treasury Note": None,
        "Microsoft account: 12": "MSFT", "Par Petroleum Corporation": "PARR", "apple cash fund": None, "nothing": None, "Pineapple": None, "Micr": None, "Micros": "MSFT", "": None,
    }
    texts = spark.createDataFrame([(t,) for t in want], "text string")
    got = {r.text: r.symbol for r in identities.match_company_names(texts, companies, most_names=most_names).collect()}
    assert got == want | {"Micr": "MSFT"}


def test_names_bridge_and_open_positions_come_first(spark):
    rows = [("congress:CHUCK NOLAN", 1, "a"), ("congress:CHARLES J NOLAN", 2, "b"), ("congress:CHARLES K NOLAN", 3, "c"), ("congress:CHARLES NOLAN", 4, "d"), ("officer:CHUCK NOLAN", 5, "e"), ("congress:BILL Q", 6, "f"), ("congress:WILLIAM Q", 7, "g"), ("congress:X", 8, "h")]
    events = spark.createDataFrame(rows, "actor string, seen int, spelling string")

    def got(open_):
        held = spark.createDataFrame([(x,) for x in open_], "actor string")
        return {r.actor.split(":")[1] + r.actor[0]: r.identity.split(":")[1] for r in identities.coalesce_actors(events, held, "actor", "seen", "spelling").collect()}

    assert got([]) == {"CHUCK NOLANc": "CHUCK NOLAN", "CHARLES J NOLANc": "CHUCK NOLAN", "CHARLES K NOLANc": "CHUCK NOLAN", "CHARLES NOLANc": "CHUCK NOLAN", "CHUCK NOLANo": "CHUCK NOLAN", "BILL Qc": "BILL Q", "WILLIAM Qc": "BILL Q", "Xc": "X"}
    first = got(["congress:CHARLES K NOLAN", "congress:WILLIAM Q"])
    assert first["CHARLES J NOLANc"] == "CHARLES J NOLAN" and first["CHUCK NOLANc"] == first["CHARLES NOLANc"] == "CHARLES K NOLAN" and first["BILL Qc"] == "WILLIAM Q"


def test_symbols_with_null_keys_stay_and_later_names_go(spark):
    rows = [("ALPHABET A", "k"), ("ALPHABET B", "k"), ("ALPHABET A", None), ("ALPHABET B", None), ("GOOG", "x"), ("ALPHABET C", "x"), ("ALPHABET A", "k"), ("SWEEP CASH", "k"), ("WHAT IS THIS", "k")]
    df = spark.createDataFrame(rows, "ticker string, key string")
    names = spark.createDataFrame([("ALPHABET", "GOOG")], "name string, symbol string")
    got = sorted(((r.ticker or "-", r.key or "-") for r in identities.clean_symbols(df, names, ["key"]).collect()))
    assert got == [("-", "k"), ("GOOG", "-"), ("GOOG", "-"), ("GOOG", "k"), ("GOOG", "k"), ("GOOG", "x"), ("WHAT IS THIS", "k")]


def test_a_sale_before_any_purchase_meets_none(spark):
    at = lambda d, side, q, p, s="S": (s, side, float(q), float(p), DAY + dt.timedelta(days=d), d)
    rows = [at(0, "STC", 10, 5), at(1, "BTO", 10, 4), at(0, "BTO", 10, 1, "A"), at(50, "BTO", 10, 2, "A"), at(99, "STC", 15, 3, "A"), at(200, "STC", 15, 4, "A"), at(300, "BTO", 4, 7, "A"), at(0, "BTC", 5, 1, "H"), at(1, "STO", 20, 9, "H"), at(40, "BTC", 8, 6, "H")]
    m = fills.matched_fills(spark.createDataFrame(rows, "ticker string, side string, qty double, price double, date date, n int"), "ticker", "date", ["n"])
    got = {r.ticker: (r.matched, r.realised, r.open_qty, r.open_entry, r.over_closes, r.discarded) for r in fills.fills_fifo(m, "ticker").collect()}
    assert got == {"S": (0.0, 0.0, 10.0, 4.0, 1, 10.0), "A": (20.0, 10 * 2 + 5 * 1 + 5 * 2.0, 4.0, 7.0, 1, 10.0), "H": (8.0, 24.0, -12.0, 0.0, 1, 5.0)}


def test_an_amendment_replaces_the_report_of_its_quarter(spark):
    q = dt.date(2024, 3, 31)
    rows = [("M", "A", q, DAY, "r1", 100, 1, 0.5, None), ("M", "A", q, DAY + dt.timedelta(days=9), "r2", 120, 2, None, None), ("M", "A", q, DAY + dt.timedelta(days=99), "r3", 5, 2, 0.1, None), ("M", "B", q, DAY, "r1", 7, 0, 0.1, "bad"), ("M", "C", q, DAY, "r1", 0, -7, 0.0, None)]
    df = spark.createDataFrame(rows, "member string, ticker string, snapshot_date date, disclosure_date date, source_record_id string, shares long, change long, pct double, bad string")
    got = {r.ticker: (r.source_record_id, r.state, r.shares, r.pct) for r in portfolio.latest_share_state(df, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {"A": ("r2", "held", 120, None), "B": ("r1", "unavailable", None, None), "C": ("r1", "absent", 0, 0.0)}


def test_an_invalid_factor_blocks(spark):
    factors = spark.createDataFrame([("A", DAY, 0.5), ("A", DAY + dt.timedelta(days=1), 0.0), ("A", DAY + dt.timedelta(days=2), None)], "ticker string, date date, factor double")
    rows = spark.createDataFrame([("A", DAY, 10.0), ("A", DAY + dt.timedelta(days=5), 10.0), ("B", DAY, 10.0)], "ticker string, day date, filed double")
    got = sorted(((r.ticker, r.day, r.adjusted, r.blocked) for r in prices.adjusted_filed_price(rows, factors).collect()), key=str)
    assert [(t, a, b) for t, _, a, b in got] == [("A", 5.0, None), ("A", None, "invalid_adjustment_factor"), ("B", None, "no_adjustment_factor")]


def test_reasons_of_a_setup(spark):
    c = [("A", "congress:JOE DOE", "congress", "house_pdf", 100.0, DAY, False, False, None), ("A", "officer:X", "officer", "form4", 50.0, DAY, False, False, None), ("A", "officer:Y", "officer", "form4", None, DAY, False, False, "held back")]
    columns = "ticker string, actor_id string, kind string, source string, entry_ref double, disclosure_date date, corroboration boolean, position_evidence boolean, blocked_reason string"
    df = spark.createDataFrame(c, columns).withColumns({"as_of": F.lit(DAY), "holding_state": F.lit(None).cast("string"), "shares_held": F.lit(None).cast("double")})
    weights = spark.createDataFrame([(DAY, "congress:JOE DOE", 1.2), (DAY, "officer:X", 1.0)], "as_of date, actor_id string, weight double")
    quotes = spark.createDataFrame([(DAY, "A", 90.0, DAY)], "as_of date, ticker string, current double, quote_date date")
    ranked, blocked = setups.setup_scores(df, weights, quotes)
    (r,) = ranked.collect()
    assert (r.score, r.actors, r.reasons) == (1.2, ["congress:JOE DOE"], ["JOE DOE buy @100.00 (est.), now 90.00 (-10.0%)"])
    assert {(b.actor_id, b.reason) for b in blocked.collect()} == {("officer:X", "above entry tolerance"), ("officer:Y", "held back")}


def test_cohort_panels_feed_the_summary(spark):
    panel = spark.createDataFrame([(DAY + dt.timedelta(days=30 * (i % 3)), f"T{i}", i % 2 == 0, float(i) if i % 2 == 0 else None, i % 5 != 0, float(i % 4) - 1) for i in range(30)], "as_of date, ticker string, ranked boolean, score double, entry_eligible boolean, excess double")
    scored = cohorts.score_quintiles(panel)
    assert {r.score_quintile for r in scored.where("ranked").collect()} <= {f"Q{i}" for i in range(1, 6)} and scored.where("NOT ranked AND score_quintile IS NOT NULL").count() == 0
    assert {r.metric for r in cohort_summary(scored, reps=20).collect()} == {"group_mean", "score_quintile_mean", "primary_top_quintile_vs_zero", "ranked_minus_baseline"}


def test_targets_are_ranked_by_value_then_score(spark):
    rows = [(DAY, "A", "X", 1.0, 0.6, 2.0, 1.0, None), (DAY, "B", "Y", 2.0, 0.6, 2.0, 1.0, 0.5), (DAY, "C", "Z", 5.0, 0.9, 2.0, 1.0, 0.2), (DAY, "D", "nan", 5.0, 0.9, 2.0, 1.0, 0.2), (DAY, "E", "V", 0.0, 0.9, 2.0, 1.0, 0.2), (DAY, "F", "U", 1.0, 0.34, 2.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "as_of date, ticker string, member string, score double, p double, win double, loss double, crash double")
    got = portfolio.portfolio_targets(df, per_member=1.0).orderBy("rank").collect()
    assert [(r.ticker, round(r.kelly, 6)) for r in got] == [("C", 0.425), ("B", 0.2), ("A", 0.2)] and got[1].position_value == got[2].position_value == pytest.approx(20_000)
    guarded = portfolio.portfolio_targets(df, per_member=1.0, crash_guard=True).orderBy("rank").collect()
    assert [(r.ticker, round(r.kelly, 6)) for r in guarded] == [("C", 0.34), ("B", 0.1)]
