"""Queries of the portfolio operators over the fixture views, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fills as W
from ..operators import portfolio as B
from ..sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
O, D, P = "fx_outcomes", "fx_disclosures", "fx_purchases"


def _query(name: str, sql: str | None, *views: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


_RET = f"r AS (SELECT as_of, alpha, CASE WHEN tx_id % 9 <> 0 THEN alpha + 0.5 END AS ret FROM {O})"


def _ret(o: DataFrame) -> DataFrame:
    return o.select("as_of", "alpha", F.when(F.col("tx_id") % 9 != 0, F.col("alpha") + 0.5).alias("ret"))


@_query("g10_complete_baskets", f"WITH {_RET} SELECT as_of, count(*) AS rows, count(*) FILTER (WHERE ret IS NULL) AS incomplete_rows, count(*) = count(ret) AS complete FROM r GROUP BY as_of", O)
def _(o):
    return B.complete_baskets(_ret(o))


@_query("g11_period_returns", f"WITH {_RET} SELECT as_of, avg(ret) AS ret, avg(alpha) AS alpha FROM r GROUP BY as_of HAVING count(*) = count(ret)", O)
def _(o):
    return B.period_returns(_ret(o))


_PANEL = f"""WITH {_RET}, b AS (SELECT date AS as_of, close / 64 - 2 AS bench_ret FROM fx_prices WHERE ticker = 'SPY' AND extract(day FROM date) <> 13),
d AS (SELECT session_date AS as_of FROM fx_sessions), p AS (SELECT as_of, count(*) AS n, count(ret) AS m, avg(ret) AS mean_ret FROM r GROUP BY as_of),
j AS (SELECT d.as_of, coalesce(n, 0) AS n, m, mean_ret, bench_ret FROM d LEFT JOIN p USING (as_of) LEFT JOIN b USING (as_of) WHERE n IS NOT NULL OR bench_ret IS NOT NULL),
k AS (SELECT *, CASE WHEN bench_ret IS NULL THEN 'benchmark_unavailable' WHEN n > 0 AND m = 0 THEN 'no_evaluable_recommendations' WHEN m < n THEN 'incomplete_basket' END AS reason FROM j),
panel AS (SELECT as_of, CASE WHEN reason IS NOT NULL THEN 'unavailable' WHEN n = 0 THEN 'cash' ELSE 'invested' END AS state, reason, CASE WHEN reason IS NULL THEN CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE mean_ret END END AS strategy_ret, CASE WHEN reason IS NULL THEN bench_ret END AS bench_ret FROM k)"""


def _panel(o: DataFrame, prices: DataFrame, sessions: DataFrame) -> DataFrame:
    bench = prices.where("ticker = 'SPY' AND day(date) <> 13").select(F.col("date").alias("as_of"), (F.col("close") / 64 - 2).alias("bench_ret"))
    return B.backtest_panel(sessions.select(F.col("session_date").alias("as_of")), _ret(o), bench)


@_query("g13_backtest_panel", f"{_PANEL} SELECT *, strategy_ret - bench_ret AS net_alpha FROM panel", O, "fx_prices", "fx_sessions")
def _(o, prices, sessions):
    return _panel(o, prices, sessions)


@_query("g12_backtest_summary", f"{_PANEL} SELECT count(*) AS periods, avg((strategy_ret > 0)::INT) AS win_rate, round(avg(strategy_ret), 9) AS mean_return, round(avg(strategy_ret - bench_ret), 9) AS mean_net_alpha FROM panel WHERE state <> 'unavailable'", O, "fx_prices", "fx_sessions")
def _(o, prices, sessions):
    return B.backtest_summary(_panel(o, prices, sessions)).withColumns({c: F.round(c, 9) for c in ("mean_return", "mean_net_alpha")})


_SIZED = f"""SELECT tx_id, as_of, ticker, CASE tx_id % 29 WHEN 0 THEN ' Unknown ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE member END AS member, CAST(CASE WHEN tx_id % 31 = 0 THEN 0 ELSE tx_id % 17 + 1 END AS double) AS score, (score + 1) / CAST(32 AS double) AS p, CAST(1 + tx_id % 5 AS double) AS win, CAST(tx_id % 37 % 4 AS double) AS loss,
 CASE WHEN tx_id % 41 = 0 THEN NULL WHEN tx_id % 43 = 0 THEN CAST(1.5 AS double) ELSE CAST(tx_id % 8 AS double) / CAST(16 AS double) END AS crash FROM {O}"""


def _sized_sql(guard: bool) -> str:
    keep, shrink = (" AND crash BETWEEN 0 AND 1", " * (1 - crash)") if guard else ("", "")
    return f"""WITH s AS ({_SIZED}), k AS (SELECT *, greatest((p * (win / loss) - (1 - p)) / (win / loss), 0.0) * 0.5{shrink} AS w0 FROM s WHERE score > 0 AND loss > 0 AND p > 0 AND p < 1 AND trim(member) <> '' AND lower(trim(member)) <> 'unknown'{keep}), g AS (SELECT * FROM k WHERE w0 > 0.01),
a AS (SELECT *, w0 * least(1.0::DOUBLE, 0.2::DOUBLE / sum(w0) OVER (PARTITION BY as_of, ticker)) AS w1 FROM g), b AS (SELECT *, w1 * least(1.0::DOUBLE, 0.05::DOUBLE / sum(w1) OVER (PARTITION BY as_of, member)) AS w2 FROM a)
SELECT tx_id, coalesce(crash, 0) AS crash, round(w2 * least(1.0::DOUBLE, 1.0::DOUBLE / sum(w2) OVER (PARTITION BY as_of)), 10) AS weight FROM b"""


def _sized(o: DataFrame, guard: bool) -> DataFrame:
    rows = o.sparkSession.sql(_SIZED.replace(O, "{o}"), o=o)
    return B.portfolio_targets(rows, crash_guard=guard).select("tx_id", "crash", F.round("weight", 10).alias("weight"))


@_query("g57_portfolio_targets", _sized_sql(False), O)
def _(o):
    return _sized(o, False)


@_query("g57_crash_guarded_targets", _sized_sql(True), O)
def _(o):
    return _sized(o, True)


_CURVE = "c AS (SELECT ticker, date, max(close) AS value FROM fx_prices WHERE close > 0 GROUP BY 1, 2)"


def _curve(p: DataFrame) -> DataFrame:
    return p.where("close > 0").groupBy("ticker", "date").agg(F.max("close").alias("value"))


@_query("w09_running_drawdown", f"WITH {_CURVE} SELECT ticker, date, value, value / max(value) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM c", "fx_prices")
def _(p):
    return B.running_drawdown(_curve(p), "ticker", "date", "value")


@_query(
    "g44_equity_curve_metrics",
    f"""WITH {_CURVE}, s AS (SELECT *, value / lag(value) OVER w - 1 AS r, date_diff('day', lag(date) OVER w, date) AS gap, value / max(value) OVER w - 1 AS dd FROM c WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, round(arg_max(value, date) / arg_min(value, date) - 1, 9) AS total_return, round(pow(arg_max(value, date) / arg_min(value, date), 365.25 / date_diff('day', min(date), max(date))) - 1, 9) AS annual_return,
 round(avg(r) / stddev_samp(r) * sqrt(365.25 / avg(gap)), 7) AS sharpe, min(dd) AS max_drawdown FROM s GROUP BY ticker""",
    "fx_prices",
)
def _(p):
    m = B.equity_curve_metrics(_curve(p), "ticker", "date", "value")
    return m.select("ticker", F.round("total_return", 9).alias("total_return"), F.round("annual_return", 9).alias("annual_return"), F.round("sharpe", 7).alias("sharpe"), "max_drawdown")


@_query("g45_trade_ledger_stats", f"SELECT member, count(*) AS trades, avg((alpha > 0)::INT) AS win_rate, avg(score) AS mean_days FROM {O} GROUP BY member", O)
def _(o):
    return B.trade_ledger_stats(o.withColumns({"pnl": F.col("alpha"), "days": F.col("score")}), "member")


_TRADES = f"""t AS (SELECT member, ticker, CASE transaction_type WHEN 'Purchase' THEN 'buy' ELSE CASE WHEN raw_transaction_subtype = 'Sale (Full)' THEN 'close' ELSE 'sell' END END AS kind, quantity::DOUBLE AS qty, amount_midpoint AS price,
 row_number() OVER (PARTITION BY member, ticker ORDER BY transaction_date, order_key, line_number, part_key, supp_key, quantity, amount_midpoint) AS n FROM {D} WHERE transaction_type <> 'Exchange')"""


def _trades(d: DataFrame) -> DataFrame:
    kind = F.when(F.col("transaction_type") == "Purchase", "buy").when(F.col("raw_transaction_subtype") == "Sale (Full)", "close").otherwise("sell")
    n = F.row_number().over(Window.partitionBy("member", "ticker").orderBy("transaction_date", "order_key", "line_number", "part_key", "supp_key", "quantity", "amount_midpoint"))
    return d.where("transaction_type <> 'Exchange'").select("member", "ticker", kind.alias("kind"), F.col("quantity").cast("double").alias("qty"), F.col("amount_midpoint").alias("price"), n.alias("n"))


@_query(
    "w07_open_lots_fifo",
    f"""WITH RECURSIVE {_TRADES},
step AS (
  SELECT member, ticker, 0::BIGINT AS n, []::STRUCT(n BIGINT, q DOUBLE)[] AS lots FROM (SELECT DISTINCT member, ticker FROM t)
  UNION ALL
  SELECT s.member, s.ticker, t.n, CASE t.kind WHEN 'buy' THEN list_append(s.lots, {{'n': t.n, 'q': t.qty}}) WHEN 'close' THEN []
   ELSE list_filter(list_transform(s.lots, lambda x, i: {{'n': x.n, 'q': x.q - greatest(0.0, least(x.q, t.qty - coalesce(list_sum(list_transform(s.lots[1:i - 1], lambda y: y.q)), 0.0)))}}), lambda z: z.q > 0) END
  FROM step s JOIN t ON t.member = s.member AND t.ticker = s.ticker AND t.n = s.n + 1),
fin AS (SELECT member, ticker, unnest(arg_max(lots, n)) AS lot FROM step GROUP BY 1, 2)
SELECT member, ticker, lot.n AS n, lot.q AS remaining FROM fin""",
    D,
)
def _(d):
    return B.open_lots_fifo(_trades(d), ["member", "ticker"], ["n"]).select("member", "ticker", "n", "remaining")


# Fills by symbol: exchanges are shorts, in symbols of their own; every third symbol of longs sells first.
_FILLS = f"""fl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date, n) AS m FROM (
 SELECT CASE WHEN transaction_type = 'Exchange' THEN concat(ticker, 'S') ELSE ticker END AS ticker, CASE transaction_type WHEN 'Purchase' THEN 'BTO' WHEN 'Sale' THEN 'STC' ELSE CASE WHEN line_number % 2 = 0 THEN 'STO' ELSE 'BTC' END END AS side, quantity::DOUBLE AS qty, (part_key % 90 + 10)::DOUBLE AS price, transaction_date AS date,
  concat(lpad(order_key::VARCHAR, 9, '0'), line_number, lpad(part_key::VARCHAR, 7, '0'), lpad(supp_key::VARCHAR, 7, '0'), lpad(quantity::INT::VARCHAR, 3, '0'), transaction_type) AS n FROM {D}))"""


def _fills(d: DataFrame) -> DataFrame:
    kind = F.col("transaction_type")
    side = F.when(kind == "Purchase", "BTO").when(kind == "Sale", "STC").otherwise(F.when(F.col("line_number") % 2 == 0, "STO").otherwise("BTC"))
    text = lambda c, n: F.lpad(F.col(c).cast("long").cast("string"), n, "0")
    n = F.concat(text("order_key", 9), F.col("line_number").cast("string"), text("part_key", 7), text("supp_key", 7), text("quantity", 3), kind)
    return d.select(F.when(kind == "Exchange", F.concat("ticker", F.lit("S"))).otherwise(F.col("ticker")).alias("ticker"), side.alias("side"), F.col("quantity").cast("double").alias("qty"), (F.col("part_key") % 90 + 10).cast("double").alias("price"), F.col("transaction_date").alias("date"), n.alias("n"))


# Fill by fill, as a blotter is read: lots in a queue, and what exceeds them falls away.
_QUEUE = f"""{_FILLS},
qs AS (
  SELECT ticker, 0::BIGINT AS m, []::STRUCT(p DOUBLE, q DOUBLE)[] AS lots, 0.0::DOUBLE AS realised, 0.0::DOUBLE AS matched, 0::BIGINT AS over_, 0.0::DOUBLE AS lost FROM (SELECT DISTINCT ticker FROM fl)
  UNION ALL
  SELECT ticker, m, CASE WHEN side IN ('BTO', 'STO') THEN list_append(lots, {{'p': price, 'q': qty}}) ELSE list_filter(list_transform(lots, lambda x, i: {{'p': x.p, 'q': x.q - took[i]}}), lambda z: z.q > 0) END,
   CASE WHEN side IN ('BTO', 'STO') THEN realised ELSE realised + coalesce(list_sum(list_transform(lots, lambda x, i: took[i] * CASE side WHEN 'STC' THEN price - x.p ELSE x.p - price END)), 0) END,
   CASE WHEN side IN ('BTO', 'STO') THEN matched ELSE matched + coalesce(list_sum(took), 0) END, CASE WHEN side NOT IN ('BTO', 'STO') AND coalesce(list_sum(took), 0) < qty THEN over_ + 1 ELSE over_ END, CASE WHEN side NOT IN ('BTO', 'STO') THEN lost + qty - coalesce(list_sum(took), 0) ELSE lost END
  FROM (SELECT s.ticker, fl.m, s.lots, s.realised, s.matched, s.over_, s.lost, side, price, qty, list_transform(s.lots, lambda x, i: greatest(0.0, least(x.q, qty - coalesce(list_sum(list_transform(s.lots[1:i - 1], lambda y: y.q)), 0.0)))) AS took FROM qs s JOIN fl ON fl.ticker = s.ticker AND fl.m = s.m + 1)),
qe AS MATERIALIZED (SELECT ticker, e.*, CASE WHEN e.side_ = 'STO' OR e.side_ = 'BTC' THEN -1 ELSE 1 END AS sg FROM (SELECT ticker, arg_max({{'lots': lots, 'realised': realised, 'matched': matched, 'over_': over_, 'lost': lost, 'side_': CASE WHEN ticker LIKE '%S' AND length(ticker) > 3 THEN 'STO' ELSE 'BTO' END}}, m) AS e FROM qs GROUP BY ticker)),
qf AS (SELECT ticker, matched, realised, sg * coalesce(list_sum(list_transform(lots, lambda x: x.q)), 0) AS open_qty, CASE WHEN sg = 1 AND len(lots) > 0 THEN list_sum(list_transform(lots, lambda x: x.p * x.q)) / list_sum(list_transform(lots, lambda x: x.q)) ELSE 0 END AS open_entry, over_ AS over_closes, lost AS discarded FROM qe)"""


@_query("w08_fills_fifo", f"WITH RECURSIVE {_QUEUE} SELECT ticker, matched, realised, open_qty, round(open_entry, 9) AS open_entry, over_closes, discarded FROM qf", D)
def _(d):
    return W.fills_fifo(W.matched_fills(_fills(d), "ticker", "date", ["n"]), "ticker").withColumn("open_entry", F.round("open_entry", 9))


@_query("w08_over_closes", f"WITH RECURSIVE {_QUEUE} SELECT fl.ticker, fl.date, fl.side, fl.qty, a.lost - b.lost AS excess FROM qs a JOIN qs b ON a.ticker = b.ticker AND a.m = b.m + 1 JOIN fl ON fl.ticker = a.ticker AND fl.m = a.m WHERE a.lost > b.lost", D)
def _(d):
    return W.over_closes(W.matched_fills(_fills(d), "ticker", "date", ["n"])).select("ticker", "date", "side", "qty", "excess")


@_query("j27_proximity_window", f"SELECT r.ticker, r.day, count(*) FILTER (WHERE g <= 7) AS within_7, count(*) FILTER (WHERE g <= 30) AS within_30, min(g) AS closest FROM (SELECT r.ticker, r.day, date_diff('day', p.disclosure_date, r.day) AS g FROM (SELECT DISTINCT ticker, transaction_date AS day FROM {D} WHERE transaction_type = 'Sale') r JOIN {P} p ON p.ticker = r.ticker) r WHERE g BETWEEN 0 AND 30 GROUP BY 1, 2", D, P)
def _(d, p):
    refs = d.where("transaction_type = 'Sale'").select("ticker", F.col("transaction_date").alias("day"))
    return B.proximity_window(refs, p.select("ticker", F.col("disclosure_date").alias("day")), [7, 30])


@_query(
    "j25_position_changes",
    """WITH h AS (SELECT member AS manager, ticker AS cusip, extract(year FROM transaction_date) AS y, sum(quantity)::DOUBLE AS shares, sum(quantity * 2)::DOUBLE AS value FROM fx_disclosures GROUP BY 1, 2, 3),
a AS (SELECT manager, cusip, shares, value / sum(value) OVER (PARTITION BY manager) AS share FROM h WHERE y = 1998), b AS (SELECT manager, cusip, shares AS old_shares, value / sum(value) OVER (PARTITION BY manager) AS old_share FROM h WHERE y = 1997)
SELECT manager, cusip, coalesce(shares, 0) - coalesce(old_shares, 0) AS share_change, coalesce(share, 0) - coalesce(old_share, 0) AS weight_change, CASE WHEN coalesce(shares, 0) > coalesce(old_shares, 0) THEN 'Purchase' WHEN coalesce(shares, 0) < coalesce(old_shares, 0) THEN 'Sale' ELSE 'Snapshot' END AS kind FROM a FULL JOIN b USING (manager, cusip)""",
    D,
)
def _(d):
    h = d.groupBy(F.col("member").alias("manager"), F.col("ticker").alias("cusip"), F.year("transaction_date").alias("y")).agg(F.sum("quantity").cast("double").alias("shares"), F.sum(F.col("quantity") * 2).cast("double").alias("value"))
    return B.position_changes(h.where("y = 1998"), h.where("y = 1997"))


@_query("g58_mark_positions", f"WITH q AS (SELECT tx_id, ticker, quantity AS qty, disclosure_date AS entry, disclosure_date + 45 AS exit FROM {P}) SELECT session_date AS date, count(*) AS held, count(*) FILTER (WHERE close IS NULL) AS unpriced, sum(qty * close) AS value FROM q JOIN fx_sessions ON session_date >= entry AND session_date < exit LEFT JOIN (SELECT ticker, date, max(close) AS close FROM fx_prices WHERE close > 0 GROUP BY 1, 2) p ON p.ticker = q.ticker AND p.date = session_date GROUP BY 1", P, "fx_sessions", "fx_prices")
def _(p, sessions, prices):
    held = p.select("tx_id", "ticker", F.col("quantity").alias("qty"), F.col("disclosure_date").alias("entry"), F.date_add("disclosure_date", 45).alias("exit"))
    return B.mark_positions(held, sessions, prices.where("close > 0").groupBy("ticker", "date").agg(F.max("close").alias("close")))


_SETUPS = f"""WITH e AS (SELECT ticker, member AS actor, (score + 1) / 24 AS weight, pow(0.5::DOUBLE, (tx_id % 60) / 90.0::DOUBLE) AS decay, 100.0::DOUBLE AS ref, 80.0::DOUBLE + tx_id % 40 AS price FROM {O} WHERE as_of BETWEEN DATE '1998-04-01' AND DATE '1998-06-01'),
b AS (SELECT ticker, actor, max(weight * decay) AS c FROM e WHERE price <= 1.05 * ref GROUP BY 1, 2 HAVING max(weight * decay) >= 0.05),
s AS (SELECT ticker, sum(c) AS total, count(*) AS actors, ticker LIKE '%X' AS corroborated FROM b GROUP BY 1), z AS (SELECT *, total * CASE WHEN corroborated THEN 1.5 ELSE 1.0 END AS score FROM s)"""


@_query("g53_setup_scores", f"{_SETUPS} SELECT ticker, round(total, 9) AS total, actors, corroborated, round(score, 9) AS score, score >= 1.0 OR (score > 0.25 AND (actors >= 2 OR corroborated)) AS ranked FROM z", O)
def _setups(o):
    e = o.where("as_of BETWEEN DATE '1998-04-01' AND DATE '1998-06-01'").select("ticker", F.col("member").alias("actor"), ((F.col("score") + 1) / 24).alias("weight"), F.pow(F.lit(0.5), (F.col("tx_id") % 60) / 90.0).alias("decay"), F.lit(100.0).alias("ref"), (80.0 + F.col("tx_id") % 40).alias("price"))
    s = B.setup_scores(e, F.col("ticker").like("%X"))
    return s.withColumns({"total": F.round("total", 9), "score": F.round("score", 9)})


@_query("k04_ranked_setups", f"{_SETUPS}, y AS (SELECT ticker, round(total, 9) AS total, actors, corroborated, round(score, 9) AS score, score >= 1.0 OR (score > 0.25 AND (actors >= 2 OR corroborated)) AS ranked FROM z) SELECT * FROM y WHERE ranked ORDER BY score DESC, ticker LIMIT 20", O)
def _(o):
    return B.ranked_setups(_setups(o), 20)


@_query("k05_closest_before", f"WITH r AS (SELECT DISTINCT ticker, transaction_date AS day FROM {D} WHERE transaction_type = 'Sale'), b AS (SELECT DISTINCT ticker, disclosure_date AS bought FROM {P}) SELECT ticker, day, bought, date_diff('day', bought, day) AS gap FROM (SELECT r.ticker, r.day, b.bought FROM r ASOF JOIN b ON r.ticker = b.ticker AND r.day >= b.bought) WHERE date_diff('day', bought, day) <= 90", D, P)
def _(d, p):
    return B.closest_before(d.where("transaction_type = 'Sale'").select("ticker", F.col("transaction_date").alias("day")), p.select("ticker", F.col("disclosure_date").alias("day")), 90)


@_query("f15_valid_sizing_rows", f"""WITH s AS (SELECT tx_id, as_of, ticker, CASE tx_id % 17 WHEN 0 THEN ' ' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN NULL ELSE member END AS member, CASE tx_id % 13 WHEN 0 THEN NULL ELSE score / 22 END AS p, (tx_id % 5)::DOUBLE AS win, (1 + tx_id % 3)::DOUBLE AS loss FROM {O})
SELECT tx_id, reject FROM (SELECT tx_id, CASE WHEN p IS NULL THEN 'not_finite' WHEN NOT (p > 0 AND p < 1) THEN 'probability' WHEN win <= 0 THEN 'win_or_loss' WHEN trim(coalesce(member, '')) IN ('', 'UNKNOWN') THEN 'member' WHEN count(*) OVER (PARTITION BY as_of, ticker) > 1 THEN 'repeated' END AS reject FROM s) WHERE reject IS NOT NULL""", O)
def _(o):
    k = F.col("tx_id")
    member = F.when(k % 17 == 0, " ").when(k % 17 == 1, "UNKNOWN").when(k % 17 == 2, None).otherwise(F.col("member"))
    rows = o.select("tx_id", "as_of", "ticker", member.alias("member"), F.when(k % 13 != 0, F.col("score") / 22).alias("p"), (k % 5).cast("double").alias("win"), (1 + k % 3).cast("double").alias("loss"))
    return B.sizing_rejects(rows).select("tx_id", "reject")


@_query("g51_portfolio_share", f"WITH h AS (SELECT member, ticker, extract(year FROM transaction_date)::INT AS year, CASE WHEN max(part_key) % 61 <> 0 THEN sum(quantity)::DOUBLE END AS value FROM {D} GROUP BY 1, 2, 3) SELECT member, ticker, year, CASE WHEN bool_and(value IS NOT NULL) OVER w THEN value / sum(value) OVER w END AS share FROM h WINDOW w AS (PARTITION BY member, year)", D)
def _(d):
    h = d.groupBy("member", "ticker", F.year("transaction_date").alias("year")).agg(F.when(F.max("part_key") % 61 != 0, F.sum("quantity").cast("double")).alias("value"))
    return B.portfolio_share(h, ["member", "year"]).select("member", "ticker", "year", "share")


# Reports of 13F: a quarter's report and its amendment are of one snapshot; a row may be malformed.
_SHARES = f"""s AS (SELECT member, ticker, (date_trunc('quarter', transaction_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS snapshot_date, disclosure_date, source_record_id, CASE WHEN part_key % 19 <> 0 THEN (quantity - part_key % 3)::BIGINT END AS shares, (line_number - 3)::BIGINT AS change, CASE WHEN part_key % 7 <> 0 THEN quantity / 64.0::DOUBLE END AS pct,
 CASE WHEN part_key % 19 = 0 THEN 'corroboration unavailable: malformed 13F share snapshot' END AS bad FROM {D} WHERE source = '13f')"""


@_query("g50_latest_share_state", f"""WITH {_SHARES}, k AS (SELECT * FROM s WHERE snapshot_date <= DATE '2000-06-30' AND disclosure_date <= DATE '2000-06-30'),
l AS (SELECT *, rank() OVER (PARTITION BY member, ticker ORDER BY snapshot_date DESC, disclosure_date DESC, source_record_id DESC) AS r FROM k)
SELECT member, ticker, snapshot_date, disclosure_date, source_record_id, count(*) AS rows, CASE WHEN min(bad) IS NOT NULL THEN 'unavailable' WHEN sum(shares) > 0 THEN 'held' ELSE 'absent' END AS state, CASE WHEN min(bad) IS NULL THEN sum(shares) END::BIGINT AS shares, CASE WHEN min(bad) IS NULL THEN sum(change) END::BIGINT AS change,
 CASE WHEN min(bad) IS NULL AND count(pct) = count(*) THEN sum(pct) END AS pct, coalesce(min(bad), CASE WHEN sum(shares) <= 0 THEN 'corroboration unavailable: 13F position absent at as_of' END) AS reason FROM l WHERE r = 1 GROUP BY 1, 2, 3, 4, 5""", D)
def _(d):
    bad, k = F.col("part_key") % 19 == 0, F.col("part_key")
    quarter = F.date_sub(F.add_months(F.trunc("transaction_date", "quarter"), 3), 1)
    rows = d.where("source = '13f'").select(
        "member", "ticker", quarter.alias("snapshot_date"), "disclosure_date", "source_record_id", F.when(~bad, (F.col("quantity") - k % 3).cast("long")).alias("shares"), (F.col("line_number") - 3).cast("long").alias("change"),
        F.when(k % 7 != 0, F.col("quantity") / 64.0).alias("pct"), F.when(bad, "corroboration unavailable: malformed 13F share snapshot").alias("bad"))
    return B.latest_share_state(rows, F.lit("2000-06-30").cast("date"))


_WINDOWS = (30, 45, 60, 90)


@_query(
    "g56_blotter_report",
    f"""WITH RECURSIVE {_QUEUE},
ba AS (SELECT ticker, count(*) AS fills, min(date) FILTER (WHERE side = 'BTO') AS first_buy, sum(price * qty) FILTER (WHERE side IN ('BTO', 'STO')) AS oc, sum(qty) FILTER (WHERE side IN ('BTO', 'STO')) AS oq, sum(price * qty) FILTER (WHERE side IN ('STC', 'BTC')) AS cc, sum(qty) FILTER (WHERE side IN ('STC', 'BTC')) AS cq FROM fl GROUP BY 1),
tr AS (SELECT DISTINCT ticker, member, CASE WHEN part_key % 5 <> 0 THEN transaction_date END AS td, disclosure_date AS dd, transaction_type AS tt FROM {D}), de AS (SELECT tr.*, coalesce(td, dd) AS on_, first_buy - coalesce(td, dd) AS ahead FROM tr JOIN ba USING (ticker)),
ne AS (SELECT ticker, count(*) AS trades, count(*) FILTER (WHERE tt = 'Purchase') AS n_buys, max(on_) - min(on_) AS span_days, {", ".join(f"count(*) FILTER (WHERE tt = 'Purchase' AND ahead BETWEEN 0 AND {n}) AS within_{n}" for n in _WINDOWS)}, min(ahead) FILTER (WHERE tt = 'Purchase' AND ahead >= 0) AS closest FROM de GROUP BY 1),
pr AS (SELECT ticker, arg_max(close, date) AS current FROM (SELECT ticker, date, max(close) AS close FROM fx_prices WHERE ticker <= 'TT' GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT ba.*, qf.* EXCLUDE (ticker), current AS cur, coalesce(trades, 0) AS trades, coalesce(n_buys, 0) AS n_buys, coalesce(span_days, 0) AS span_days, {", ".join(f"coalesce(within_{n}, 0) AS within_{n}" for n in _WINDOWS)}, closest FROM ba JOIN qf USING (ticker) LEFT JOIN ne USING (ticker) LEFT JOIN pr USING (ticker))
SELECT ticker, fills, CASE WHEN open_qty <> 0 THEN open_qty ELSE coalesce(oq, 0) END AS qty, round(CASE WHEN open_qty <> 0 THEN open_entry ELSE coalesce(oc / oq, 0) END, 8) AS entry, round(CASE WHEN open_qty <> 0 THEN cur ELSE cc / cq END, 8) AS current,
 round(CASE WHEN open_qty > 0 THEN cur - open_entry WHEN open_qty < 0 THEN open_entry - cur WHEN oq > 0 THEN realised / oq WHEN realised <> 0 THEN 0 END, 8) AS pnl_unit, round(CASE WHEN open_qty > 0 THEN (cur - open_entry) * open_qty WHEN open_qty < 0 THEN (open_entry - cur) * -open_qty WHEN oq > 0 OR realised <> 0 THEN realised END, 5) AS pnl,
 CASE WHEN open_qty > 0 AND cur IS NULL THEN 'OPEN (unrealized); market price unavailable' WHEN open_qty < 0 AND cur IS NULL THEN 'OPEN short (unrealized); market price unavailable' WHEN open_qty > 0 THEN 'open, unrealized' WHEN open_qty < 0 THEN 'open short, unrealized' WHEN oq > 0 OR realised <> 0 THEN 'CLOSED, realized' ELSE 'flat / no position' END AS note,
 realised, over_closes, trades, n_buys, span_days, {", ".join(f"within_{n}" for n in _WINDOWS)}, {", ".join(f"CASE WHEN n_buys > 0 AND span_days > 0 THEN round(1 - exp(-n_buys::DOUBLE / span_days::DOUBLE * {n}.0::DOUBLE), 4) ELSE 0 END AS chance_{n}" for n in _WINDOWS)}, closest, within_60 > 0 AS proxy_hit FROM z""",
    D, "fx_prices",
)
def _(d, prices):
    matched = W.matched_fills(_fills(d), "ticker", "date", ["n"])
    trades = d.withColumn("transaction_date", F.when(F.col("part_key") % 5 != 0, F.col("transaction_date")))
    last = prices.where("ticker <= 'TT'").groupBy("ticker", "date").agg(F.max("close").alias("close")).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    return W.blotter_report(matched, trades, last).withColumns({"entry": F.round("entry", 8), "current": F.round("current", 8), "pnl_unit": F.round("pnl_unit", 8), "pnl": F.round("pnl", 5)})
