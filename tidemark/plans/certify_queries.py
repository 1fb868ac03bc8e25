"""Queries of price certification and refresh over the fixture views, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import certify as K
from ..operators import prices as P
from ..sources.fixtures import view, with_views
from .market_queries import _DAYS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str, *views: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


# Two or three generations of every series; by the second letter: A agrees, B a close is off, C a split, D a dividend with its
# factor step, E a step of no kind, F a dividend without its step, G factors that differ, H one generation, I a repeated day,
# J an ex-date without a price, K a raw jump, L a dividend above the price.
_GEN = """g AS (SELECT 'g1' AS generation, 1.0::DOUBLE AS scale UNION ALL SELECT 'g2', 2.0 UNION ALL SELECT 'g3', 0.5),
one AS (SELECT ticker, date, max(close) AS close, substr(ticker, 2, 1) AS s FROM fx_prices WHERE ticker <> 'SPY' GROUP BY 1, 2),
mid AS (SELECT ticker, s, min(date) + (date_diff('day', min(date), max(date)) // 2)::INT AS half FROM one GROUP BY 1, 2),
turn AS (SELECT o.ticker, o.s, min(o.date) AS at_ FROM one o JOIN mid USING (ticker) WHERE o.date >= half GROUP BY 1, 2),
prev AS (SELECT o.ticker, arg_max(o.close, o.date) AS before FROM one o JOIN turn t ON t.ticker = o.ticker AND o.date < at_ GROUP BY 1),
vals AS (SELECT o.ticker, generation, date, close * scale * CASE WHEN s = 'B' AND generation = 'g2' AND date = at_ THEN 1.01 ELSE 1.0 END * CASE WHEN s = 'K' AND date >= at_ THEN 4.0 ELSE 1.0 END AS close,
  scale * CASE WHEN s = 'C' AND date < at_ THEN 0.5 WHEN s = 'D' AND date >= at_ THEN 1 / (1 - 1 / 64.0::DOUBLE) WHEN s = 'E' AND date >= at_ THEN 1.00337 WHEN s = 'G' AND generation = 'g2' AND date >= at_ THEN 1.5 ELSE 1.0 END AS adjustment_factor
 FROM one o JOIN turn USING (ticker, s) CROSS JOIN g WHERE (generation <> 'g3' OR ticker LIKE '%X%') AND (s <> 'H' OR generation = 'g1')
 UNION ALL SELECT o.ticker, 'g1', date, close, 1.0 FROM one o JOIN turn USING (ticker, s) WHERE s = 'I' AND date = at_),
divs AS (SELECT ticker, at_ + CASE WHEN s = 'J' THEN extract(dow FROM at_) * -1 ELSE 0 END::INT AS ex_date, CASE WHEN s = 'D' THEN before / 64 WHEN s = 'F' THEN before / 50.3 WHEN s = 'L' THEN before * 2 ELSE 1.0 END AS cash_amount FROM turn JOIN prev USING (ticker) WHERE s IN ('D', 'F', 'J', 'L'))"""

# The same rules, pair by pair and step by step.
_VERDICT = """gens AS (SELECT {k}, generation, min(date) AS a, max(date) AS z, count(*) AS n, count(DISTINCT date) AS d FROM {v} GROUP BY ALL),
per AS (SELECT {k}, count(*) AS fetches, arg_max(generation, (z, n, generation)) AS keeper, bool_or(d < n) AS invalid FROM gens GROUP BY ALL),
met AS (SELECT {kx}, x.generation AS ga, y.generation AS gb, x.date, x.close / y.close AS r, x.adjustment_factor / y.adjustment_factor AS f FROM {v} x JOIN {v} y ON {on} AND x.date = y.date AND x.generation < y.generation),
lst AS (SELECT {k}, ga, gb, count(*) AS n, arg_max(r, date) AS lr, arg_max(f, date) AS lf FROM met GROUP BY ALL),
dif AS (SELECT {k}, ga, gb, any_value(n) AS n, max(abs(r / lr - 1)) AS ce, max(abs(f / lf - 1)) AS fe FROM met JOIN lst USING ({k}, ga, gb) GROUP BY ALL),
agr AS (SELECT {k}, count(*) AS pairs, min(n) AS least, max(ce) AS ce, max(fe) AS fe FROM dif GROUP BY ALL),
st0 AS (SELECT *, close / adjustment_factor AS raw, row_number() OVER w AS i, lag(close / adjustment_factor) OVER w AS r0, lag(close) OVER w AS c0, lag(adjustment_factor) OVER w AS f0 FROM {v} WINDOW w AS (PARTITION BY {k}, generation ORDER BY date)),
st1 AS (SELECT s.*, cash_amount, adjustment_factor / f0 * CASE WHEN cash_amount < r0 THEN 1 - cash_amount / r0 ELSE 1 END AS chg FROM st0 s LEFT JOIN divs ON divs.ticker = s.ticker AND ex_date = date),
st2 AS (SELECT *, abs(chg - 1) > 2e-6 AS moved, abs(chg - 1) > 2e-6 AND len(list_filter(range(1, 101), lambda q: round(chg * q) <> q AND abs(round(chg * q) / q / chg - 1) <= 2e-6)) > 0 AND raw / r0 * chg BETWEEN 0.5 AND 2 AND close / c0 BETWEEN 0.5 AND 2 AS split FROM st1),
tld AS (SELECT {k}, bool_or(cash_amount >= r0) AS imp, bool_or(moved AND NOT split) AS une, bool_or((raw / r0 <= 0.5 OR raw / r0 >= 2) AND NOT split) AS jmp, count(*) FILTER (WHERE split) AS splits FROM st2 GROUP BY ALL),
due AS (SELECT DISTINCT {kg} FROM gens JOIN divs ON divs.ticker = gens.ticker AND ex_date BETWEEN a AND z WHERE NOT EXISTS (SELECT 1 FROM st0 WHERE {dk} AND st0.generation = gens.generation AND st0.date = ex_date AND i > 1)),
ver AS (SELECT {k}, keeper, fetches, splits, CASE WHEN fetches < 2 THEN 'fewer_than_two_generations' WHEN invalid THEN 'invalid_values' WHEN coalesce(pairs, 0) < fetches * (fetches - 1) / 2 OR least < 2 THEN 'too_few_shared_dates' WHEN ce > 1.2e-6 THEN 'closes_disagree' WHEN fe > 2e-6 THEN 'factors_disagree'
 WHEN missing THEN 'dividend_without_prices' WHEN imp THEN 'impossible_dividend' WHEN une THEN 'unexplained_factor_step' WHEN jmp THEN 'unexplained_raw_jump' END AS reason FROM per LEFT JOIN agr USING ({k}) LEFT JOIN tld USING ({k}) LEFT JOIN (SELECT *, true AS missing FROM due) USING ({k}))"""
_BY_TICKER = _VERDICT.format(v="vals", k="ticker", kx="x.ticker", on="x.ticker = y.ticker", kg="gens.ticker", dk="st0.ticker = gens.ticker")
_BY_PAIR = _VERDICT.format(v="sets", k="ticker, against", kx="x.ticker, x.against", on="x.ticker = y.ticker AND x.against = y.against", kg="gens.ticker, gens.against", dk="st0.ticker = gens.ticker AND st0.against = gens.against")


def _generations(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Dealt out by ticker once, before generations multiply the rows; windows and the operators keep to that. No close is null: asked for
    # everywhere, it lets parts that need no close read the same shuffle.
    one = prices.where("ticker <> 'SPY'").repartition("ticker").groupBy("ticker", "date").agg(F.max("close").alias("close")).where("close IS NOT NULL")
    w = Window.partitionBy("ticker")
    one = one.withColumn("half", F.date_add(F.min("date").over(w), F.expr("int(datediff(max(date) OVER (PARTITION BY ticker), min(date) OVER (PARTITION BY ticker)) div 2)")))
    one = one.withColumn("at", F.min(F.when(F.col("date") >= F.col("half"), F.col("date"))).over(w)).withColumn("s", F.substring("ticker", 2, 1))
    one = one.withColumn("before", F.max_by(F.when(F.col("date") < F.col("at"), F.col("close")), F.when(F.col("date") < F.col("at"), F.col("date"))).over(w))
    kinds = "array(struct('g1' AS generation, 1.0D AS scale, false AS again), struct('g2' AS generation, 2.0D AS scale, false AS again), struct('g3' AS generation, 0.5D AS scale, false AS again), struct('g1' AS generation, 1.0D AS scale, true AS again))"
    vals = one.withColumn("g", F.explode(F.expr(kinds))).select("*", "g.*").where("CASE WHEN again THEN s = 'I' AND date = at ELSE (generation <> 'g3' OR ticker LIKE '%X%') AND (s <> 'H' OR generation = 'g1') END").selectExpr(
        "ticker", "generation", "date", "close * scale * CASE WHEN s = 'B' AND generation = 'g2' AND date = at THEN 1.01D ELSE 1.0D END * CASE WHEN s = 'K' AND date >= at THEN 4.0D ELSE 1.0D END AS close",
        "scale * CASE WHEN s = 'C' AND date < at THEN 0.5D WHEN s = 'D' AND date >= at THEN 1 / (1 - 1 / 64.0D) WHEN s = 'E' AND date >= at THEN 1.00337D WHEN s = 'G' AND generation = 'g2' AND date >= at THEN 1.5D ELSE 1.0D END AS adjustment_factor",
    )
    ex = "date_sub(at, CASE WHEN s = 'J' THEN dayofweek(at) - 1 ELSE 0 END)"
    cash = "CASE WHEN before IS NOT NULL THEN CASE s WHEN 'D' THEN before / 64 WHEN 'F' THEN before / 50.3D WHEN 'L' THEN before * 2 WHEN 'J' THEN 1.0D END END"
    divs = one.where("date = at").selectExpr("ticker", f"{ex} AS ex_date", f"{cash} AS cash_amount").where("cash_amount IS NOT NULL")
    return vals, divs


@_query("g47_certify_series", f"WITH {_GEN},\n{_BY_TICKER} SELECT ticker, keeper, fetches, splits, reason, reason IS NULL AS certified FROM ver", "fx_prices")
def _(prices):
    return K.certify_series(*_generations(prices))


@_query(
    "g48_rebaseline_plan",
    f"""WITH {_GEN}, sets AS (SELECT *, generation AS against FROM vals WHERE generation <> 'g1' UNION ALL SELECT v.*, o.generation FROM vals v JOIN (SELECT DISTINCT ticker, generation FROM vals WHERE generation <> 'g1') o ON v.ticker = o.ticker WHERE v.generation = 'g1'),
{_BY_PAIR}
SELECT t.ticker, 'g1' AS keeper, coalesce(string_agg(against, ',' ORDER BY against) FILTER (WHERE against IS NOT NULL AND reason IS NULL), '') AS kept, coalesce(string_agg(against, ',' ORDER BY against) FILTER (WHERE reason IS NOT NULL), '') AS deleted FROM (SELECT DISTINCT ticker FROM vals) t LEFT JOIN ver USING (ticker) GROUP BY 1""",
    "fx_prices",
)
def _(prices):
    values, dividends = _generations(prices)
    return K.rebaseline_plan(values, dividends, values.select("ticker", F.lit("g1").alias("keeper")).distinct())


@_query(
    "c06_merge_price_refresh",
    """WITH one AS (SELECT ticker, date, max(close) AS close, extract(day FROM date) AS n FROM fx_prices GROUP BY 1, 2), old AS (SELECT * FROM one WHERE n % 3 <> 0), new AS (SELECT ticker, date, close * CASE WHEN ticker LIKE 'TB%' AND n = 10 THEN 1.01 ELSE 1.0 END AS close FROM one WHERE n % 2 = 0 AND ticker NOT LIKE 'TC%'),
j AS (SELECT new.ticker, new.date, new.close, old.close AS held FROM new LEFT JOIN old USING (ticker, date)), rep AS (SELECT ticker, count(held) AS shared, count(*) FILTER (WHERE abs(held - close) / abs(close) > 0.001) AS conflicts, count(*) FILTER (WHERE held IS NULL) AS absent FROM j GROUP BY 1),
own AS (SELECT ticker, count(*) AS held, sum(close) AS total FROM old GROUP BY 1), ins AS (SELECT ticker, count(*) AS inserted, sum(close) AS added FROM j WHERE held IS NULL GROUP BY 1)
SELECT ticker, held + CASE WHEN conflicts = 0 THEN coalesce(inserted, 0) ELSE 0 END AS rows, total + CASE WHEN conflicts = 0 THEN coalesce(added, 0) ELSE 0 END AS total, shared, conflicts, CASE WHEN conflicts > 0 THEN 0 ELSE absent END AS inserted FROM own LEFT JOIN ins USING (ticker) LEFT JOIN rep USING (ticker)""",
    "fx_prices",
)
def _(prices):
    one = prices.groupBy("ticker", "date").agg(F.max("close").alias("close"))
    new = one.where("day(date) % 2 = 0").withColumn("close", F.col("close") * F.expr("CASE WHEN ticker LIKE 'TB%' AND day(date) = 10 THEN 1.01D ELSE 1.0D END"))
    merged, report = K.merge_price_refresh(new, one.where("day(date) % 3 <> 0"), one.where("ticker NOT LIKE 'TC%'").select("ticker"))
    return merged.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("total")).join(report, "ticker", "left")


# A refresh of even days against what is stored: TB has days that are off, TC is not eligible, TE never overlaps and is left open.
_REFRESH = """one AS MATERIALIZED (SELECT ticker, date, max(close) AS close, extract(day FROM date)::INT AS n FROM fx_prices GROUP BY 1, 2), old AS (SELECT ticker, date, close FROM one WHERE n % 3 <> 0 AND NOT (ticker LIKE 'TE%' AND n % 2 = 0)),
new AS (SELECT ticker, date, close * CASE WHEN ticker LIKE 'TB%' AND n = 10 THEN 1.01 ELSE 1.0 END AS close FROM one WHERE n % 2 = 0), rs AS (SELECT ticker, count(*) FILTER (WHERE abs(o.close - new.close) / abs(new.close) > 0.001) AS r, max(abs(o.close - new.close) / abs(new.close)) AS m FROM new LEFT JOIN old o USING (ticker, date) WHERE ticker NOT LIKE 'TC%' GROUP BY 1),
st AS (SELECT ticker, CASE WHEN why IS NULL THEN 'g2' WHEN ticker NOT LIKE 'TB_1%' THEN 'g1' END AS served, CASE WHEN why IS NULL THEN 'comparable' ELSE 'unknown' END AS comparability, CASE WHEN why IS NOT NULL THEN 'g2' END AS alternate, why AS reason
 FROM (SELECT *, CASE WHEN r > 0 THEN printf('price comparability unknown: %d overlaps exceed 0.1%% (max %.5f%%)', r, m * 100) WHEN ticker LIKE 'TE%' THEN 'no shared dates' END AS why FROM rs))"""


def _refresh(prices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    one = prices.groupBy("ticker", "date").agg(F.max("close").alias("close"))
    old = one.where("day(date) % 3 <> 0 AND NOT (ticker LIKE 'TE%' AND day(date) % 2 = 0)")
    new = one.where("day(date) % 2 = 0").withColumn("close", F.col("close") * F.expr("CASE WHEN ticker LIKE 'TB%' AND day(date) = 10 THEN 1.01D ELSE 1.0D END"))
    tickers = one.select("ticker").distinct()
    eligible = tickers.where("ticker NOT LIKE 'TC%'")
    states = K.refresh_states(new, old, tickers.where("ticker NOT LIKE 'TB_1%'").withColumn("served", F.lit("g1")), eligible, "g2", tickers.where("ticker LIKE 'TE%'").withColumn("reason", F.lit("no shared dates")))
    return new, old, states, eligible


@_query("c06_refresh_states", f"WITH {_REFRESH} SELECT * FROM st", "fx_prices")
def _(prices):
    return _refresh(prices)[2]


# What a merge that lost the third day of four of each month has not brought.
@_query(
    "c06_refresh_missing",
    f"""WITH {_REFRESH}, mg AS (SELECT ticker, date FROM old UNION SELECT ticker, date FROM new WHERE extract(day FROM date) <> 12), dv AS (SELECT DISTINCT ticker, date AS ex_date FROM one WHERE n = 14)
SELECT 'price' AS kind, ticker, date FROM new WHERE ticker NOT LIKE 'TC%' AND (ticker, date) NOT IN (SELECT * FROM mg) AND ticker NOT IN (SELECT ticker FROM st WHERE comparability = 'unknown')
UNION ALL SELECT 'dividend', ticker, ex_date FROM dv WHERE ticker NOT LIKE 'TC%' AND ticker LIKE '%X%'""",
    "fx_prices",
)
def _(prices):
    new, old, states, eligible = _refresh(prices)
    merged = old.select("ticker", "date").union(new.where("day(date) <> 12").select("ticker", "date")).distinct()
    dividends = new.where("day(date) = 14").select("ticker", F.col("date").alias("ex_date"), F.lit(1.0).alias("cash_amount"))
    kept = K.merge_dividends(dividends.where("ticker NOT LIKE '%X%'"), dividends.where("false"), eligible)
    return K.refresh_missing(new, merged, states, eligible, dividends, kept)


@_query(
    "c05_outcome_labels",
    f"""WITH {_DAYS.replace("days AS (", "days AS MATERIALIZED (")}, served AS MATERIALIZED (SELECT ticker, date, max(close) AS close FROM fx_prices WHERE ticker NOT LIKE 'TC%' AND NOT (ticker LIKE 'TD%' AND extract(day FROM date) = 5) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT k.ticker, decision_date AS disclosure_date, d.next_session AS entry_date, x.prev_session AS exit_date FROM fx_decisions k LEFT JOIN days d ON d.day = decision_date LEFT JOIN days x ON x.day = d.next_session + 60),
q AS MATERIALIZED (SELECT e.*, a.close AS p0, b.close AS p1, m.close AS b0, n.close AS b1 FROM e LEFT JOIN served a ON a.ticker = e.ticker AND a.date = entry_date LEFT JOIN served b ON b.ticker = e.ticker AND b.date = exit_date LEFT JOIN served m ON m.ticker = 'SPY' AND m.date = entry_date LEFT JOIN served n ON n.ticker = 'SPY' AND n.date = exit_date),
r AS (SELECT *, CASE WHEN ticker LIKE 'TC%' THEN 'ticker_not_certified' WHEN p0 IS NULL THEN 'entry_quote_unavailable' WHEN p1 IS NULL THEN 'exit_quote_unavailable' WHEN b0 IS NULL OR b1 IS NULL THEN 'benchmark_quote_unavailable' END AS exclusion, round((p1 * 0.999 / (p0 * 1.001) - 1) * 100, 8) AS f, round((b1 * 0.999 / (b0 * 1.001) - 1) * 100, 8) AS b FROM q)
SELECT ticker, disclosure_date, entry_date, CASE WHEN ticker LIKE 'TC%' THEN 'uncertifiable' WHEN exclusion IS NOT NULL THEN 'outcome_missing' ELSE 'available' END AS status, exclusion, CASE WHEN exclusion IS NULL THEN f END AS fwd, CASE WHEN exclusion IS NULL THEN b END AS bench FROM r""",
    "fx_decisions", "fx_prices", "fx_sessions",
)
def _(decisions, prices, sessions):
    values = prices.where("NOT (ticker LIKE 'TD%' AND day(date) = 5)").groupBy("ticker", "date").agg(F.max("close").alias("close")).withColumn("generation", F.lit("g1"))
    state = prices.select("ticker").distinct().select("ticker", F.lit("g1").alias("served"), (~F.col("ticker").like("TC%")).alias("comparable"), F.lit("adjusted").alias("basis"))
    out = K.outcome_labels(decisions.withColumnRenamed("decision_date", "disclosure_date"), values, state, P.session_days(sessions), 60, 0.001, 0.001)
    return out.select("ticker", "disclosure_date", "entry_date", "status", "exclusion", F.round("fwd", 8).alias("fwd"), F.round("bench", 8).alias("bench"))
