"""Baskets, sizing, lots and curves, from tables of trades and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import kelly_fraction


def complete_baskets(rows: DataFrame, date: str = "as_of", ret: str = "ret") -> DataFrame:
    """Per date its rows, those without a return, and whether the basket is complete."""
    per = rows.groupBy(date).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ret).isNull()).alias("incomplete_rows"))
    return per.withColumn("complete", F.col("incomplete_rows") == 0)


def period_returns(rows: DataFrame, date: str = "as_of") -> DataFrame:
    """Equal-weight means of complete baskets."""
    return rows.groupBy(date).agg(F.avg("ret").alias("ret"), F.avg("alpha").alias("alpha"), F.count_if(F.col("ret").isNull()).alias("open")).where("open = 0").drop("open")


def backtest_panel(dates: DataFrame, rows: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per decision date: invested, cash or unavailable with the reason, and the net alpha.

    ``bench`` has the benchmark's return per date. Dates without recommendations and benchmark are left out.
    """
    per = rows.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.count("ret").alias("measured"), F.avg("ret").alias("mean_ret"))
    out = dates.join(per, "as_of", "left").join(bench, "as_of", "left").where("n IS NOT NULL OR bench_ret IS NOT NULL")
    n, b = F.coalesce("n", F.lit(0)), F.col("bench_ret")
    reason = F.when(b.isNull(), "benchmark_unavailable").when((n > 0) & (F.col("measured") == 0), "no_evaluable_recommendations").when(F.col("measured") < n, "incomplete_basket")
    state = F.when(reason.isNotNull(), "unavailable").when(n == 0, "cash").otherwise("invested")
    strategy = F.when(state == "invested", F.col("mean_ret")).when(state == "cash", 0.0)
    return out.select("as_of", state.alias("state"), reason.alias("reason"), strategy.alias("strategy_ret"), F.when(reason.isNull(), b).alias("bench_ret"), (strategy - F.when(reason.isNull(), b)).alias("net_alpha"))


def backtest_summary(panel: DataFrame) -> DataFrame:
    """One row over the dates that are funded: their number, win rate and means."""
    done = panel.where("state <> 'unavailable'")
    return done.agg(F.count(F.lit(1)).alias("periods"), F.avg((F.col("strategy_ret") > 0).cast("double")).alias("win_rate"), F.avg("strategy_ret").alias("mean_return"), F.avg("net_alpha").alias("mean_net_alpha"))


def cap_group_weights(rows: DataFrame, weight: str, keys: list[str], cap: float) -> DataFrame:
    """Weights scaled down so that no group holds more than its cap."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return rows.withColumn(weight, F.col(weight) * F.least(F.lit(1.0), F.lit(cap) / total))


def portfolio_targets(rows: DataFrame, floor: float = 0.01, per_ticker: float = 0.20, per_member: float = 0.05, in_all: float = 1.0, capital: float = 100_000.0, crash_guard: bool = False) -> DataFrame:
    """Half-Kelly weights of valid rows above the floor, capped per ticker, per member, then in all, and their place in the day's order.

    ``rows``: as_of, ticker, member, score, p, win, loss and crash (probability of a crash). A row counts if all numbers are finite, the score is positive, the chance inside
    0 and 1, and the member is known. With ``crash_guard`` a fraction shrinks by its crash probability, which must be known and within 0 and 1;
    without it crash is only carried. Rank is by position value, then score, both falling, then ticker and member.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    member, ticker = F.trim("member"), F.trim("ticker")
    ok = finite("score") & finite("p") & finite("win") & finite("loss") & (F.col("score") > 0) & (F.col("p") > 0) & (F.col("p") < 1) & (F.col("win") > 0) & (F.col("loss") > 0)
    ok = ok & (ticker != "") & (member != "") & ~F.lower(member).isin("unknown", "none", "nan")
    fraction = kelly_fraction(F.col("p"), F.col("win"), F.col("loss"))
    if crash_guard:
        ok, fraction = ok & finite("crash") & F.col("crash").between(0, 1), fraction * (1 - F.col("crash"))
    good = rows.where(ok).withColumns({"ticker": ticker, "member": member, "crash": F.coalesce("crash", F.lit(0.0)), "kelly": fraction}).where(F.col("kelly") > floor).withColumn("weight", F.col("kelly"))
    for keys, cap in ((["as_of", "ticker"], per_ticker), (["as_of", "member"], per_member), (["as_of"], in_all)):
        good = cap_group_weights(good, "weight", keys, cap)
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("position_value"), F.desc("score"), "ticker", "member"))
    return good.withColumn("position_value", F.col("weight") * capital).withColumn("rank", place)


def running_drawdown(curve: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Value over its running maximum, less 1."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("drawdown", F.col(value) / F.max(value).over(w) - 1)


def equity_curve_metrics(curve: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Total and yearly return, Sharpe ratio at the observed pace, and deepest drawdown; all null if a value is missing."""
    w = Window.partitionBy(key).orderBy(date)
    before = F.lag(value).over(w)
    steps = running_drawdown(curve, key, date, value).withColumns({"r": F.when(before > 0, F.col(value) / before - 1).when(before.isNotNull(), 0.0), "gap": F.datediff(date, F.lag(date).over(w))})
    m = steps.groupBy(key).agg(
        F.min_by(value, date).alias("first"), F.max_by(value, date).alias("last"), F.datediff(F.max(date), F.min(date)).alias("days"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.avg("gap").alias("pace"), F.min("drawdown").alias("low"), F.count_if(F.col(value).isNull()).alias("open"), F.count("r").alias("n"),
    )
    ok = F.col("open") == 0
    total = F.col("last") / F.col("first") - 1
    return m.select(
        key,
        F.when(ok, total).alias("total_return"),
        F.when(ok & (F.col("days") > 0), F.pow(1 + total, 365.25 / F.col("days")) - 1).alias("annual_return"),
        F.when(ok, F.when((F.col("n") < 2) | (F.coalesce("sd", F.lit(0.0)) == 0), 0.0).otherwise(F.col("mean") / F.col("sd") * F.sqrt(365.25 / F.col("pace")))).alias("sharpe"),
        F.when(ok, F.col("low")).alias("max_drawdown"),
    )


def trade_ledger_stats(trades: DataFrame, key: str) -> DataFrame:
    """Closed trades, win rate and mean days held."""
    return trades.groupBy(key).agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("days").alias("mean_days"))


def open_lots_fifo(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What is left of each purchase after first-in-first-out sales; more sold than held is discarded.

    ``trades`` has qty (shares) and kind: buy, sell, or close (sells all). A close begins a new segment. In a
    segment the open quantity is the running sum reflected at zero, and the lots left are the latest purchases
    that make it up: three windows over one (key) order, no state carried row by row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = trades.withColumn("segment", F.coalesce(F.sum((F.col("kind") == "close").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = seg.withColumn("last_segment", F.coalesce(F.sum((F.col("kind") == "close").cast("int")).over(Window.partitionBy(*keys)), F.lit(0))).where("segment = last_segment AND kind <> 'close'")
    signed = F.when(F.col("kind") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    run = seg.withColumn("net", F.sum(signed).over(upto))
    all_ = Window.partitionBy(*keys)
    run = run.withColumns({"end": F.last("net").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "low": F.min("net").over(all_)})
    run = run.withColumn("open", F.col("end") - F.least(F.lit(0.0), F.col("low")))
    back = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum(F.when(F.col("kind") == "buy", F.col("qty")).otherwise(0.0)).over(back), F.lit(0.0))
    left = F.greatest(F.lit(0.0), F.least(F.col("qty"), F.col("open") - later))
    return run.withColumn("remaining", F.when(F.col("kind") == "buy", left)).where("remaining > 0").drop("net", "end", "low", "open", "segment", "last_segment")


def _near(refs: DataFrame, buys: DataFrame, most: int) -> DataFrame:
    """Pairs of a reference day and a buy of its symbol at most so many days before: they meet by symbol and bucket of that many days."""
    size = most + 1
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / size)
    asked = refs.select("ticker", "day").distinct().withColumn("bucket", F.explode(F.array(bucket(F.col("day")) - 1, bucket(F.col("day")))))
    had = buys.select("ticker", F.col("day").alias("bought")).withColumn("bucket", bucket(F.col("bought")))
    return asked.join(had, ["ticker", "bucket"]).withColumn("gap", F.datediff("day", "bought")).where(F.col("gap").between(0, most))


def proximity_window(refs: DataFrame, buys: DataFrame, windows: list[int]) -> DataFrame:
    """For each reference date how many buys of the symbol came within each window before it, and the closest."""
    near = _near(refs, buys, max(windows))
    return near.groupBy("ticker", "day").agg(*(F.count_if(F.col("gap") <= n).alias(f"within_{n}") for n in windows), F.min("gap").alias("closest"))


def closest_before(refs: DataFrame, buys: DataFrame, most: int) -> DataFrame:
    """K5: the nearest buy of the symbol on or up to ``most`` days before each reference date."""
    return _near(refs, buys, most).groupBy("ticker", "day").agg(F.max("bought").alias("bought"), F.min("gap").alias("gap"))


def portfolio_share(holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Value over the filing's total; null for all of a filing if one value is missing."""
    w = Window.partitionBy(*keys)
    whole = F.bool_and(F.col("value").isNotNull()).over(w)
    return holdings.withColumn("share", F.when(whole, F.col("value") / F.sum("value").over(w)))


def latest_share_state(rows: DataFrame, as_of: Column) -> DataFrame:
    """Per member and ticker the shares that the latest known 13F report states, summed over its rows; unavailable, with the reason, if one is malformed.

    ``rows``: member, ticker, snapshot_date, disclosure_date, source_record_id, shares, change, pct and bad (why a row cannot be read, or null). Known are
    rows whose both dates are at most ``as_of``; the latest report is the last by snapshot, disclosure and record, so an amendment of a
    quarter replaces what it amends. The share of the portfolio is null if one row has none.
    """
    known = rows.where((F.col("snapshot_date") <= as_of) & (F.col("disclosure_date") <= as_of))
    report = F.struct("snapshot_date", "disclosure_date", "source_record_id")
    per = known.groupBy("member", "ticker", report.alias("report")).agg(
        F.sum("shares").alias("__shares"), F.sum("change").alias("__change"), F.when(F.bool_and(F.col("pct").isNotNull()), F.sum("pct")).alias("__pct"), F.min("bad").alias("reason"), F.count(F.lit(1)).alias("rows"))
    last = per.groupBy("member", "ticker").agg(F.max_by(F.struct(*(c for c in per.columns if c not in ("member", "ticker"))), "report").alias("r")).select("member", "ticker", "r.*")
    ok = F.col("reason").isNull()
    state = F.when(~ok, "unavailable").when(F.col("__shares") > 0, "held").otherwise("absent")
    why = F.coalesce("reason", F.when(state != "held", "corroboration unavailable: 13F position absent at as_of"))
    return last.select("member", "ticker", "report.*", "rows", state.alias("state"), *(F.when(ok, F.col(f"__{c}")).alias(c) for c in ("shares", "change", "pct")), why.alias("reason"))


def sizing_rejects(rows: DataFrame) -> DataFrame:
    """rows that may not be sized, with the first reason: numbers out of range, an unknown member, a repeated date and ticker."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    again = F.count(F.lit(1)).over(Window.partitionBy("as_of", "ticker")) > 1
    reason = (
        F.when(~(finite("p") & finite("win") & finite("loss")), "not_finite").when(~((F.col("p") > 0) & (F.col("p") < 1)), "probability")
        .when(~((F.col("win") > 0) & (F.col("loss") > 0)), "win_or_loss").when(F.trim(F.coalesce("member", F.lit(""))).isin("", "UNKNOWN"), "member").when(again, "repeated")
    )
    return rows.withColumn("reject", reason).where("reject IS NOT NULL")


def position_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Holdings against the quarter before: change in shares and in portfolio share, and what it amounts to."""
    share = lambda d, n: d.withColumn(n, F.col("value") / F.sum("value").over(Window.partitionBy("manager")))
    a = share(now, "share").select("manager", "cusip", "shares", "share")
    b = share(before, "old_share").select("manager", "cusip", F.col("shares").alias("old_shares"), "old_share")
    both = a.join(b, ["manager", "cusip"], "full_outer")
    change = F.coalesce("shares", F.lit(0.0)) - F.coalesce("old_shares", F.lit(0.0))
    kind = F.when(change > 0, "Purchase").when(change < 0, "Sale").otherwise("Snapshot")
    return both.select("manager", "cusip", change.alias("share_change"), (F.coalesce("share", F.lit(0.0)) - F.coalesce("old_share", F.lit(0.0))).alias("weight_change"), kind.alias("kind"))


def mark_positions(positions: DataFrame, sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """Per session the value of the positions held on it, and how many have no price that day."""
    days = positions.where("entry < exit").withColumn("date", F.explode(F.sequence("entry", F.date_sub("exit", 1))))
    held = days.join(sessions.select(F.col("session_date").alias("date")), "date", "left_semi")
    return held.join(prices, ["ticker", "date"], "left").groupBy("date").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("close").isNull()).alias("unpriced"), F.sum(F.col("qty") * F.col("close")).alias("value"))


def discount_alerts(positions: DataFrame, below: float, least_cost: float) -> DataFrame:
    """positions at a discount of at least ``below`` percent and above a minimum cost."""
    return positions.where((F.col("discount") <= -below) & (F.col("cost") >= least_cost))


def gate_closed_events(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Events of an actor without an open position lose their reference, with the reason."""
    held = positions.groupBy(F.upper("ticker").alias("__t"), F.col("member").alias("__m")).agg(F.min("first_lot").alias("first_lot"))
    out = events.join(held, (F.upper("ticker") == F.col("__t")) & (F.col("member") == F.col("__m")), "left")
    reason = F.when(F.col("first_lot").isNull(), "no_open_position").when(F.col("event_date") < F.col("first_lot"), "before_first_lot")
    return out.withColumn("blocked", reason).withColumn("entry_ref", F.when(reason.isNull(), F.col("entry_ref"))).drop("__t", "__m", "first_lot")


def setup_scores(rows: DataFrame, corroborated: Column) -> DataFrame:
    """Per ticker the best evidence of each actor, summed, raised if corroborated, and whether it ranks.

    ``rows`` has ticker, actor, weight, decay, ref and price; usable is a price of at most 1.05 times a positive reference.
    """
    usable = rows.where((F.col("ref") > 0) & (F.col("price") > 0) & (F.col("price") <= 1.05 * F.col("ref")) & (F.col("decay") > 0))
    best = usable.groupBy("ticker", "actor").agg(F.max(F.col("weight") * F.col("decay")).alias("contribution")).where("contribution >= 0.05")
    per = best.groupBy("ticker").agg(F.sum("contribution").alias("total"), F.count(F.lit(1)).alias("actors")).withColumn("corroborated", corroborated)
    scored = per.withColumn("score", F.col("total") * F.when(F.col("corroborated"), 1.5).otherwise(1.0))
    return scored.withColumn("ranked", (F.col("score") >= 1.0) | ((F.col("score") > 0.25) & ((F.col("actors") >= 2) | F.col("corroborated"))))


def ranked_setups(scores: DataFrame, n: int) -> DataFrame:
    """K4: the first n ranked setups by score, then ticker."""
    return scores.where("ranked").orderBy(F.desc("score"), "ticker").limit(n)
