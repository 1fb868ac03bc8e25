"""Queries of the consensus and price operators over the fixture views, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import prices as P
from ..sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = "1998-06-01"


def _query(name: str, sql: str, *views: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


def _day(text: str = DAY):
    return F.lit(text).cast("date")


_ELIGIBLE = "asset_description LIKE '%[ST]'"
_LEGACY = "source IN ('house_pdf', 'gemini_ocr', 'senate_efd')"
_BUYS = f"transaction_type = 'Purchase' AND {_LEGACY} AND transaction_date <= disclosure_date AND amount_midpoint >= 1001 AND {_ELIGIBLE}"


@_query("f01_disclosure_window", f"SELECT doc_id, source_row_id, ticker, disclosure_date FROM fx_disclosures WHERE disclosure_date BETWEEN DATE '{DAY}' - 28 AND DATE '{DAY}' AND ticker IS NOT NULL", "fx_disclosures")
def _(rows):
    return C.disclosure_window(rows, _day()).select("doc_id", "source_row_id", "ticker", "disclosure_date")


@_query("f02_as_of_cutoff", f"SELECT doc_id, source_row_id, disclosure_date FROM fx_disclosures WHERE disclosure_date <= DATE '{DAY}' AND (transaction_date IS NULL OR transaction_date <= DATE '{DAY}')", "fx_disclosures")
def _(rows):
    return C.as_of_cutoff(rows, _day()).select("doc_id", "source_row_id", "disclosure_date")


@_query(
    "f03_eligible_equity",
    r"""SELECT doc_id, source_row_id, NOT regexp_matches(lower(asset_description), '\b(mutual fund|treasury)\b') AND NOT (contains(lower(asset_description), '[gs]')) AND NOT contains(lower(asset_description), '[op]') AS eligible FROM fx_disclosures""",
    "fx_disclosures",
)
def _(rows):
    none = F.lit(None).cast("string")
    return rows.select("doc_id", "source_row_id", C.eligible_equity(F.col("asset_description"), F.col("source"), none, none).alias("eligible"))


@_query("f04_below_floor_reason", f"SELECT doc_id, source_row_id, CASE WHEN {_LEGACY} AND transaction_type = 'Purchase' AND amount_midpoint > 0 AND amount_midpoint < 1001 THEN 'purchase below PTR disclosure floor ($1,001)' END AS reason FROM fx_disclosures", "fx_disclosures")
def _(rows):
    return rows.select("doc_id", "source_row_id", C.below_floor_reason(F.col("source"), F.col("transaction_type"), F.col("amount_midpoint")).alias("reason"))


@_query("f05_valid_chronology", "SELECT doc_id, source_row_id FROM fx_disclosures WHERE transaction_date <= disclosure_date", "fx_disclosures")
def _(rows):
    return C.valid_chronology(rows).select("doc_id", "source_row_id")


@_query("f11_price_universe", "SELECT DISTINCT s AS symbol, CASE WHEN s IS NULL THEN 'missing' WHEN NOT regexp_full_match(s, '[A-Z]{1,5}([.-][A-Z]{1,2})?') THEN 'syntax' WHEN s IN ('FUND') THEN 'reserved' END AS reason FROM (SELECT CASE WHEN upper(trim(ticker_text)) IN ('', 'NAN', 'NONE') THEN NULL ELSE upper(trim(ticker_text)) END AS s FROM fx_text)", "fx_text")
def _(rows):
    return C.price_universe(rows.withColumnRenamed("ticker_text", "ticker"))


@_query("f12_recent_active_tickers", f"SELECT DISTINCT ticker FROM fx_disclosures WHERE disclosure_date BETWEEN DATE '{DAY}' - 5 AND DATE '{DAY}'", "fx_disclosures")
def _(rows):
    return C.recent_active_tickers(rows, _day(), 5)


_RESOLVE = "CASE WHEN t IS NULL THEN 'unresolved' WHEN t IN ('SP', 'FUND', 'THE') THEN 'quarantined' WHEN t = 'SPCX' THEN 'pre_listing' WHEN t IN ('BRK.B', 'GOOG') THEN 'class_share' WHEN t = 'FB' THEN CASE WHEN d >= DATE '2022-06-09' THEN 'renamed' ELSE 'pre_rename' END WHEN t = 'ATVI' THEN CASE WHEN d <= DATE '2023-10-13' THEN 'pre_acquisition' ELSE 'acquired' END WHEN t = 'ROBL' THEN 'pseudo' ELSE 'unverified' END"


@_query(
    "j17_resolve_ticker",
    f"""SELECT row_key, CASE WHEN s = 'class_share' THEN CASE t WHEN 'BRK.B' THEN 'BRK-B' ELSE t END WHEN s = 'renamed' THEN 'META' WHEN s = 'pseudo' THEN 'RBLX' ELSE t END AS symbol, s AS status,
 CASE WHEN s IN ('class_share', 'renamed', 'pre_rename', 'pre_acquisition') THEN 1.0::DOUBLE WHEN s = 'pseudo' THEN 0.8 ELSE 0.0 END AS confidence,
 CASE WHEN t IN ('FB') THEN 'META' WHEN t = 'BRK.B' THEN 'BRK-B' WHEN t = 'ROBL' THEN 'RBLX' ELSE t END AS family
FROM (SELECT *, {_RESOLVE} AS s FROM (SELECT row_key, CASE WHEN row_key % 5 = 0 THEN DATE '2023-10-13' ELSE DATE '2020-01-01' + (row_key * 37 % 2000)::INT END AS d, upper(nullif(CASE row_key % 9 WHEN 0 THEN 'fb' WHEN 1 THEN 'BRK.B' WHEN 2 THEN 'atvi' WHEN 3 THEN 'ROBL' WHEN 4 THEN 'SPCX' WHEN 5 THEN 'THE' WHEN 6 THEN 'AAPL' WHEN 7 THEN '' ELSE 'goog' END, '')) AS t FROM fx_text))""",
    "fx_text",
)
def _(rows):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("fb", "BRK.B", "atvi", "ROBL", "SPCX", "THE", "AAPL", "", "goog"))), (F.col("row_key") % 9 + 1).cast("int"))
    on = F.when(F.col("row_key") % 5 == 0, _day("2023-10-13")).otherwise(F.date_add(_day("2020-01-01"), (F.col("row_key") * 37 % 2000).cast("int")))
    out = C.resolve_tickers(rows.select("row_key", raw.alias("told")), "told", on)
    return out.select("row_key", "symbol", F.col("symbol_status").alias("status"), F.col("symbol_confidence").alias("confidence"), "family")


_SCORE = "count(DISTINCT member) AS num_buyers, array_to_string(list_sort(list(DISTINCT member))[1:3], ', ') AS buyers, max(date_diff('day', transaction_date, disclosure_date)) AS max_lag, median(date_diff('day', transaction_date, disclosure_date))::DOUBLE AS median_lag, max(disclosure_date) AS latest_disclosure_date, min(transaction_date) AS oldest_transaction_date, CASE WHEN count(DISTINCT member) >= 3 THEN count(DISTINCT member)::DOUBLE ELSE 0.0 END AS signal_score"


@_query("g01_distinct_buyer_score", f"SELECT ticker, {_SCORE} FROM fx_disclosures WHERE {_BUYS} AND disclosure_date BETWEEN DATE '{DAY}' - 28 AND DATE '{DAY}' GROUP BY ticker", "fx_disclosures")
def _(rows):
    return C.distinct_buyer_score(rows, _day())


@_query(
    "g03_consensus_over_dates",
    f"""SELECT as_of, ticker, {_SCORE} FROM (SELECT DATE '1995-02-06' + (7 * n)::INT AS as_of FROM (SELECT unnest(generate_series(0, 300)) AS n)) d
 JOIN fx_disclosures ON disclosure_date BETWEEN as_of - 28 AND as_of WHERE {_BUYS} GROUP BY as_of, ticker HAVING count(DISTINCT member) >= 3""",
    "fx_disclosures",
)
def _(rows):
    dates = rows.sparkSession.sql("SELECT DATE '1995-02-06' AS first, date_add(DATE '1995-02-06', 2100) AS last")
    return C.consensus_over_dates(rows, dates)


@_query("g04_buyers_table", f"SELECT ticker AS symbol, member AS buyer, count(*) AS purchases, min(disclosure_date) AS first_disclosed, max(disclosure_date) AS last_disclosed, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM fx_disclosures WHERE {_BUYS} GROUP BY ALL", "fx_disclosures")
def _(rows):
    return C.buyers_table(rows)


@_query("g05_source_coverage", f"SELECT chamber, max(disclosure_date) AS latest, count(*) FILTER (WHERE disclosure_date >= DATE '{DAY}' - 28) AS in_window, date_diff('day', max(disclosure_date), DATE '{DAY}') AS age, CASE WHEN date_diff('day', max(disclosure_date), DATE '{DAY}') <= 28 THEN 'in' ELSE 'outside' END AS state FROM fx_disclosures WHERE disclosure_date <= DATE '{DAY}' GROUP BY chamber", "fx_disclosures")
def _(rows):
    return C.source_coverage(rows, _day())


@_query("k01_rank_recommendations", f"SELECT * FROM (SELECT as_of, ticker, num_buyers, row_number() OVER (PARTITION BY as_of ORDER BY num_buyers DESC, ticker) AS rank FROM (SELECT as_of, ticker, count(DISTINCT member) AS num_buyers FROM (SELECT DATE '1995-02-06' + (7 * n)::INT AS as_of FROM (SELECT unnest(generate_series(0, 300)) AS n)) d JOIN fx_disclosures ON disclosure_date BETWEEN as_of - 28 AND as_of WHERE {_BUYS} GROUP BY as_of, ticker HAVING count(DISTINCT member) >= 3)) WHERE rank <= 5", "fx_disclosures")
def _(rows):
    dates = rows.sparkSession.sql("SELECT DATE '1995-02-06' AS first, date_add(DATE '1995-02-06', 2100) AS last")
    return C.rank_recommendations(C.consensus_over_dates(rows, dates), 5, "as_of").select("as_of", "ticker", "num_buyers", "rank")


@_query("s11_read_prices", "SELECT p.* FROM fx_prices p WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND close > 0 AND ticker IN (SELECT ticker FROM fx_disclosures)", "fx_disclosures", "fx_prices")
def _(rows, prices):
    return P.read_prices(prices, rows, _day("1997-01-01"), _day("1998-12-31"))


_WIDE = ["SPY", *(f"T{a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXY" for b in "XY")]


@_query("s12_prices_wide_to_long", "SELECT date, left(ticker, 3) AS ticker, max(close) AS close FROM fx_prices GROUP BY 1, 2 HAVING max(close) > 0", "fx_prices")
def _(prices):
    return P.prices_wide_to_long(prices.withColumn("series", F.left("ticker", F.lit(3))).groupBy("date").pivot("series", _WIDE).agg(F.max("close")))


_DAYS = "days AS (SELECT unnest(generate_series(session_date, next_session - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day, session_date AS prev_session, next_session FROM (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS next_session FROM fx_sessions) WHERE next_session IS NOT NULL)"


@_query("w18_session_days", f"WITH {_DAYS} SELECT * FROM days", "fx_sessions")
def _(sessions):
    return P.session_days(sessions)


_ENDS = f"""{_DAYS},
h AS (SELECT tx_id, ticker, disclosure_date, unnest([30, 90]) AS horizon FROM fx_purchases),
e AS (SELECT h.*, d.next_session AS entry_date, x.prev_session AS exit_date FROM h LEFT JOIN days d ON d.day = disclosure_date LEFT JOIN days x ON x.day = d.next_session + horizon),
q AS (SELECT e.*, a.close AS entry_price, b.close AS exit_price, m.close AS bench_entry, n.close AS bench_exit FROM e
 LEFT JOIN fx_prices a ON a.ticker = e.ticker AND a.date = entry_date AND a.close > 0 LEFT JOIN fx_prices b ON b.ticker = e.ticker AND b.date = exit_date AND b.close > 0
 LEFT JOIN fx_prices m ON m.ticker = 'SPY' AND m.date = entry_date LEFT JOIN fx_prices n ON n.ticker = 'SPY' AND n.date = exit_date),
ends AS (SELECT *, CASE WHEN entry_price IS NULL THEN 'entry_quote_unavailable' WHEN exit_price IS NULL THEN 'exit_quote_unavailable' WHEN bench_entry IS NULL OR bench_exit IS NULL THEN 'benchmark_quote_unavailable' END AS reason FROM q),
labels AS (SELECT *, CASE WHEN reason IS NULL THEN (exit_price / entry_price - 1) * 100 END AS total_return, CASE WHEN reason IS NULL THEN (exit_price / entry_price - 1) * 100 - (bench_exit / bench_entry - 1) * 100 END AS alpha FROM ends)"""


@_query("j08_exact_endpoints", f"WITH {_ENDS} SELECT tx_id, ticker, horizon, entry_date, exit_date, entry_price, exit_price, total_return, alpha, reason FROM labels", "fx_purchases", "fx_prices", "fx_sessions")
def _(rows, prices, sessions):
    days = P.session_days(sessions)
    return P.with_returns(P.exact_endpoints(P.explode_horizons(rows, (30, 90)), prices, days)).select("tx_id", "ticker", "horizon", "entry_date", "exit_date", "entry_price", "exit_price", "total_return", "alpha", "reason")


@_query("j10_price_asof_backward", "SELECT k.ticker, k.day, p.date AS quote_date, p.close AS quote, date_diff('day', p.date, k.day) AS gap FROM (SELECT DISTINCT ticker, disclosure_date AS day FROM fx_purchases) k ASOF LEFT JOIN (SELECT * FROM fx_prices WHERE close > 0) p ON k.ticker = p.ticker AND k.day >= p.date", "fx_purchases", "fx_prices")
def _(rows, prices):
    return P.price_asof(rows.select("ticker", F.col("disclosure_date").alias("day")).distinct(), prices)


@_query("j11_price_asof_forward", "SELECT ticker, day, CASE WHEN g <= 7 THEN date END AS quote_date, CASE WHEN g <= 7 THEN close END AS quote, CASE WHEN g <= 7 THEN g END AS gap FROM (SELECT k.ticker, k.day, p.date, p.close, date_diff('day', k.day, p.date) AS g FROM (SELECT DISTINCT ticker, disclosure_date AS day FROM fx_purchases) k ASOF LEFT JOIN (SELECT * FROM fx_prices WHERE close > 0) p ON k.ticker = p.ticker AND k.day <= p.date)", "fx_purchases", "fx_prices")
def _(rows, prices):
    return P.price_asof(rows.select("ticker", F.col("disclosure_date").alias("day")).distinct(), prices, forward=True, most_days=7)


@_query(
    "j12_price_nearest",
    """SELECT ticker, day, arg_min(date, (g, date)) FILTER (WHERE g <= 5) AS quote_date, arg_min(close, (g, date)) FILTER (WHERE g <= 5) AS quote FROM (
 SELECT k.ticker, k.day, p.date, p.close, abs(date_diff('day', k.day, p.date)) AS g FROM (SELECT DISTINCT ticker, disclosure_date AS day FROM fx_purchases) k LEFT JOIN fx_prices p ON k.ticker = p.ticker AND p.close > 0 AND p.date BETWEEN k.day - 6 AND k.day + 6) GROUP BY 1, 2""",
    "fx_purchases", "fx_prices",
)
def _(rows, prices):
    return P.price_nearest(rows.select("ticker", F.col("disclosure_date").alias("day")), prices, 5)


@_query("j13_price_path", f"WITH {_ENDS} SELECT tx_id, horizon, count(*) AS quotes, min(p.close) AS low, max(p.close) AS high FROM labels l JOIN fx_prices p ON p.ticker = l.ticker AND p.date BETWEEN l.entry_date AND l.exit_date AND p.close > 0 WHERE reason IS NULL GROUP BY 1, 2", "fx_purchases", "fx_prices", "fx_sessions")
def _(rows, prices, sessions):
    days = P.session_days(sessions)
    ends = P.exact_endpoints(P.explode_horizons(rows, (30, 90)), prices, days).where("reason is null").select("tx_id", "horizon", "ticker", "entry_date", "exit_date")
    return P.price_path(ends, prices).groupBy("tx_id", "horizon").agg(F.count(F.lit(1)).alias("quotes"), F.min("close").alias("low"), F.max("close").alias("high"))


# The benchmark has no quote on the 17th of a month, so paths hold days that it lacks.
_GAPS = _ENDS.replace("fx_prices", "gappy").replace("days AS", "gappy AS (SELECT * FROM fx_prices WHERE ticker <> 'SPY' OR extract(day FROM date) <> 17),\ndays AS", 1)
_MEANS = """path AS (SELECT l.tx_id, l.horizon, p.date, p.close, b.close AS bench, date_diff('day', l.entry_date, p.date) AS d FROM labels l JOIN gappy p ON p.ticker = l.ticker AND p.date BETWEEN l.entry_date AND l.exit_date AND p.close > 0 LEFT JOIN gappy b ON b.ticker = 'SPY' AND b.date = p.date WHERE reason IS NULL),
steps AS (SELECT *, ln(close / lag(close) OVER w) AS own, ln(bench / lag(bench) OVER w) AS other, exp(-0.005 * (d + lag(d) OVER w) / 2) AS weight FROM path WHERE bench IS NOT NULL WINDOW w AS (PARTITION BY tx_id, horizon ORDER BY date)),
means AS (SELECT tx_id, horizon, round(sum(own * weight) / sum(weight) * 100, 7) AS decayed_return, round(sum(other * weight) / sum(weight) * 100, 7) AS decayed_bench, round((sum(own * weight) - sum(other * weight)) / sum(weight) * 100, 7) AS decayed_alpha FROM steps GROUP BY 1, 2)"""


def _gappy(prices: DataFrame) -> DataFrame:
    return prices.where((F.col("ticker") != P.BENCHMARK) | (F.dayofmonth("date") != 17))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 7) for c in ("decayed_return", "decayed_bench", "decayed_alpha")})


@_query("w11_decay_weighted_log_mean", f"WITH {_GAPS},\n{_MEANS} SELECT * FROM means", "fx_purchases", "fx_prices", "fx_sessions")
def _(rows, prices, sessions):
    days, prices = P.session_days(sessions), _gappy(prices)
    ends = P.exact_endpoints(P.explode_horizons(rows.select("tx_id", "ticker", "disclosure_date"), (30, 90)), prices, days).where("reason is null")
    bench = prices.where(F.col("ticker") == P.BENCHMARK).select("date", F.col("close").alias("bench"))
    path = P.price_path(ends.select("tx_id", "horizon", "ticker", "entry_date", "exit_date"), prices).join(bench, "date", "left")
    return _rounded(P.decay_weighted_log_mean(path, ["tx_id", "horizon"]))


_LABELS = f"""WITH {_GAPS},
{_MEANS},
shape AS (SELECT tx_id, horizon, max(close) AS peak, min(close) AS trough FROM path GROUP BY 1, 2)
SELECT tx_id, horizon, total_return, alpha, peak, trough, decayed_return, decayed_bench, decayed_alpha, reason IS NULL AS complete FROM labels LEFT JOIN shape USING (tx_id, horizon) LEFT JOIN means USING (tx_id, horizon)"""


def _labels(rows: DataFrame, prices: DataFrame, sessions: DataFrame) -> DataFrame:
    labels = P.signal_labels(rows.select("tx_id", "ticker", "disclosure_date"), _gappy(prices), P.session_days(sessions), "tx_id")
    return _rounded(labels).select("tx_id", "horizon", "total_return", "alpha", "peak", "trough", "decayed_return", "decayed_bench", "decayed_alpha", "complete")


@_query("w12_signal_labels", _LABELS, "fx_purchases", "fx_prices", "fx_sessions")
def _(rows, prices, sessions):
    return _labels(rows, prices, sessions)


@_query("f06_completed_horizon", f"SELECT * FROM ({_LABELS}) WHERE horizon = 90 AND complete".replace("SELECT * FROM (WITH", "WITH", 1).replace("FROM labels LEFT JOIN shape USING (tx_id, horizon) LEFT JOIN means USING (tx_id, horizon))", "FROM labels LEFT JOIN shape USING (tx_id, horizon) LEFT JOIN means USING (tx_id, horizon)"), "fx_purchases", "fx_prices", "fx_sessions")
def _(rows, prices, sessions):
    return P.completed_horizon(_labels(rows, prices, sessions), 90)


@_query("g02_consensus_candidates", f"SELECT ticker, count(DISTINCT member) AS num_buyers FROM fx_disclosures WHERE {_BUYS} AND disclosure_date BETWEEN DATE '{DAY}' - 28 AND DATE '{DAY}' GROUP BY ticker HAVING count(DISTINCT member) >= 2", "fx_disclosures")
def _(rows):
    return C.consensus_candidates(rows, _day(), min_buyers=2)


@_query("c02_prepare_purchases", f"SELECT doc_id, source_row_id, part_key, supp_key, ticker AS symbol, ticker AS family, member AS buyer FROM fx_disclosures WHERE {_BUYS}", "fx_disclosures")
def _(rows):
    return C.prepare_purchases(rows).select("doc_id", "source_row_id", "part_key", "supp_key", "symbol", "family", "buyer")


_OLD = "CASE WHEN part_key % 25 < 5 THEN CASE part_key % 5 WHEN 0 THEN 'FB' WHEN 1 THEN 'BRK.B' WHEN 2 THEN 'ROBL' WHEN 3 THEN 'SQ' ELSE 'META' END ELSE ticker END"


@_query("j18_ticker_family", f"SELECT family, count(*) AS rows, count(DISTINCT raw) AS symbols FROM (SELECT raw, CASE raw WHEN 'FB' THEN 'META' WHEN 'BRK.B' THEN 'BRK-B' WHEN 'ROBL' THEN 'RBLX' WHEN 'SQ' THEN 'XYZ' ELSE raw END AS family FROM (SELECT {_OLD} AS raw FROM fx_disclosures)) GROUP BY family", "fx_disclosures")
def _(rows):
    out = C.resolve_tickers(rows.withColumn("raw_symbol", F.expr(_OLD)), "raw_symbol", F.col("transaction_date"))
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("raw_symbol").alias("symbols"))


# Symbols that rules change: one has quotes under its new name, one under its old.
@_query(
    "j09_entry_prices",
    f"""WITH {_DAYS.replace("days AS (", "days AS MATERIALIZED (")}, q AS MATERIALIZED (SELECT ticker, date, max(close) AS close FROM (SELECT ticker, date, close FROM fx_prices WHERE close > 0 UNION ALL SELECT CASE ticker WHEN 'SPY' THEN 'BRK-B' ELSE 'FB' END, date, close FROM fx_prices WHERE ticker = 'SPY' OR ticker = 'TAX') GROUP BY 1, 2),
r AS MATERIALIZED (SELECT order_key, line_number, part_key, supp_key, ticker, CASE ticker WHEN 'BRK.B' THEN 'BRK-B' ELSE ticker END AS symbol, disclosure_date FROM fx_filings WHERE ticker NOT IN ('SPCX') AND transaction_date <= disclosure_date)
SELECT order_key, line_number, part_key, supp_key, next_session AS entry_date, coalesce(a.close, b.close) AS entry_price, CASE WHEN a.close IS NOT NULL THEN r.symbol ELSE r.ticker END AS entry_symbol FROM r JOIN days ON day = disclosure_date LEFT JOIN q a ON a.ticker = r.symbol AND a.date = next_session LEFT JOIN q b ON b.ticker = r.ticker AND b.date = next_session WHERE coalesce(a.close, b.close) IS NOT NULL""",
    "fx_filings", "fx_prices", "fx_sessions",
)
def _(rows, prices, sessions):
    renamed = prices.where("ticker IN ('SPY', 'TAX')").select(F.when(F.col("ticker") == "SPY", "BRK-B").otherwise("FB").alias("ticker"), "date", "close")
    columns = ["order_key", "line_number", "part_key", "supp_key"]
    at = rows.select(*columns, "ticker", "transaction_date", "disclosure_date")
    return P.entry_prices(at, prices.select("ticker", "date", "close").union(renamed), P.session_days(sessions)).select(*columns, "entry_date", "entry_price", "entry_symbol")


@_query(
    "j37_adjusted_filed_price",
    """WITH f AS (SELECT ticker, date, CASE WHEN extract(month FROM date) % 4 = 0 THEN 0 ELSE max(close) / 64 END AS factor FROM fx_prices WHERE extract(day FROM date) = 3 AND ticker > 'TB' GROUP BY 1, 2), r AS (SELECT tx_id, ticker, transaction_date AS day, CASE WHEN part_key % 7 <> 0 THEN quantity::DOUBLE END AS filed FROM fx_purchases),
j AS (SELECT r.*, f.factor FROM r ASOF LEFT JOIN f ON f.ticker = r.ticker AND r.day >= f.date)
SELECT tx_id, CASE WHEN filed > 0 AND factor > 0 THEN filed * factor END AS adjusted, CASE WHEN filed IS NULL THEN 'no_filed_price' WHEN factor IS NULL THEN 'no_adjustment_factor' WHEN NOT factor > 0 THEN 'invalid_adjustment_factor' END AS blocked FROM j""",
    "fx_purchases", "fx_prices",
)
def _(rows, prices):
    factors = prices.where("day(date) = 3 AND ticker > 'TB'").groupBy("ticker", "date").agg((F.max("close") / 64).alias("factor")).withColumn("factor", F.when(F.month("date") % 4 == 0, 0.0).otherwise(F.col("factor")))
    filed = rows.select("tx_id", "ticker", F.col("transaction_date").alias("day"), F.when(F.col("part_key") % 7 != 0, F.col("quantity").cast("double")).alias("filed"))
    return P.adjusted_filed_price(filed, factors).select("tx_id", "adjusted", "blocked")


@_query("w10_step_changes", "SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) AS step FROM (SELECT ticker, date, max(close) AS close FROM fx_prices WHERE close > 0 GROUP BY 1, 2)", "fx_prices")
def _(prices):
    return P.step_changes(prices.where("close > 0").groupBy("ticker", "date").agg(F.max("close").alias("close")))


@_query("g40_price_coverage", "SELECT ticker, first_date, last_date, days, (SELECT count(*) FROM fx_sessions WHERE session_date BETWEEN first_date AND last_date) - days AS missing FROM (SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days FROM fx_prices WHERE close > 0 GROUP BY ticker)", "fx_sessions", "fx_prices")
def _(sessions, prices):
    return P.price_coverage(prices, sessions)


@_query("g41_missing_sessions", "SELECT t.ticker, session_date AS date FROM (SELECT ticker, min(date) AS lo, max(date) AS hi FROM fx_prices GROUP BY 1) t JOIN fx_sessions ON session_date BETWEEN lo AND hi ANTI JOIN (SELECT ticker, date FROM fx_prices WHERE close > 0) p ON p.ticker = t.ticker AND p.date = session_date", "fx_sessions", "fx_prices")
def _(sessions, prices):
    return P.missing_sessions(prices, sessions, prices.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")))


@_query("g42_stale_series", "SELECT ticker, max(date) AS last_date, date_diff('day', max(date), DATE '2002-07-05') AS age FROM fx_prices WHERE close > 0 GROUP BY ticker HAVING date_diff('day', max(date), DATE '2002-07-05') > 7", "fx_prices")
def _(prices):
    return P.stale_series(prices.where("close > 0"), _day("2002-07-05"), 7)


@_query(
    "w18_exchange_sessions",
    """WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), c AS (SELECT d, month(d) AS m, day(d) AS n, dayofweek(d) AS w FROM o)
SELECT d AS order_date, w IN (0, 6) OR (m = 1 AND (n = 1 AND w BETWEEN 1 AND 5 OR n = 2 AND w = 1 OR w = 1 AND n BETWEEN 15 AND 21)) OR (m = 2 AND w = 1 AND n BETWEEN 15 AND 21) OR (m = 5 AND w = 1 AND n >= 25)
 OR (m = 7 AND (n = 4 AND w BETWEEN 1 AND 5 OR n = 3 AND w = 5 OR n = 5 AND w = 1)) OR (m = 9 AND w = 1 AND n <= 7) OR (m = 11 AND w = 4 AND n BETWEEN 22 AND 28) OR (m = 12 AND (n = 25 AND w BETWEEN 1 AND 5 OR n = 24 AND w = 5 OR n = 26 AND w = 1))
 OR d IN ('1995-04-14', '1996-04-05', '1997-03-28', '1998-04-10', '1999-04-02', '2000-04-21', '2001-04-13', '2002-03-29') AS closed FROM c""",
    "orders",
)
def _(orders):
    d = F.col("o_orderdate").cast("date")
    return orders.select(d.alias("order_date")).distinct().withColumn("closed", P.exchange_closed(F.col("order_date")))


@_query(
    "g46_series_divergence",
    """WITH a AS (SELECT ticker, date, max(close) AS x FROM fx_prices WHERE ticker >= 'TC' OR date < DATE '1998-01-01' GROUP BY 1, 2), b AS (SELECT ticker, date, max(close) * CASE WHEN ticker < 'TG' THEN 1.0::DOUBLE ELSE 1.0078125 END AS y FROM fx_prices WHERE ticker >= 'TC' OR date >= DATE '1998-01-01' GROUP BY 1, 2)
SELECT ticker, count(abs(x - y) / abs(y)) AS overlap, max(abs(x - y) / abs(y)) AS max_gap, count(*) AS merged_days, CASE WHEN count(abs(x - y) / abs(y)) = 0 THEN 'unknown' WHEN max(abs(x - y) / abs(y)) <= 0.001 THEN 'comparable' ELSE 'divergent' END AS verdict FROM a FULL JOIN b USING (ticker, date) GROUP BY ticker""",
    "fx_prices",
)
def _(prices):
    one = prices.groupBy("ticker", "date").agg(F.max("close").alias("close"))
    other = one.where("ticker >= 'TC' OR date >= DATE '1998-01-01'").withColumn("close", F.col("close") * F.when(F.col("ticker") < "TG", 1.0).otherwise(1.0078125))
    return P.series_divergence(one.where("ticker >= 'TC' OR date < DATE '1998-01-01'"), other)


@_query("u06_coalesce_series", "WITH n AS (SELECT ticker, date, max(close) AS x FROM fx_prices WHERE ticker < 'TH' OR date > DATE '1997-01-01' GROUP BY 1, 2), o AS (SELECT ticker, date, min(close) AS y FROM fx_prices WHERE date < DATE '1999-01-01' GROUP BY 1, 2) SELECT ticker, date, coalesce(x, y) AS close FROM n FULL JOIN o USING (ticker, date)", "fx_prices")
def _(prices):
    new = prices.where("ticker < 'TH' OR date > DATE '1997-01-01'").groupBy("ticker", "date").agg(F.max("close").alias("close"))
    return P.coalesce_series(new, prices.where("date < DATE '1999-01-01'").groupBy("ticker", "date").agg(F.min("close").alias("close")))


@_query("n22_series_hash", "SELECT ticker, sha256(string_agg(line, chr(10) ORDER BY line)) AS series_sha256 FROM (SELECT ticker, date::VARCHAR || '=' || round(close * 32)::BIGINT AS line FROM fx_prices) GROUP BY ticker", "fx_prices")
def _(prices):
    return P.series_hash(prices)


@_query("j31_ex_dividend_block", "SELECT d.ticker, decision_date AS day, max(ex_date) AS ex_date FROM fx_decisions d JOIN (SELECT DISTINCT ticker, date AS ex_date FROM fx_prices WHERE extract(day FROM date) = 15) x ON x.ticker = d.ticker AND ex_date <= decision_date AND ex_date > decision_date - 7 GROUP BY 1, 2", "fx_decisions", "fx_prices")
def _(decisions, prices):
    dividends = prices.where(F.dayofmonth("date") == 15).select("ticker", F.col("date").alias("ex_date")).distinct()
    return P.ex_dividend_block(decisions.withColumnRenamed("decision_date", "day"), dividends)
