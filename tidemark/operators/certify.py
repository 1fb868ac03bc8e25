"""Price generations: certification against each other and against corporate actions, what to keep, and additive refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prices import exact_endpoints, valid_price
from .quality import served_prices

CLOSE_TOLERANCE, FACTOR_TOLERANCE = 1.2e-6, 2e-6  # fixed values
LARGEST_DENOMINATOR = 100


def _off(c: Column) -> Column:
    """Largest relative distance of a ratio from its value on the last shared day, within a group."""
    last = F.max_by(c, "date")
    return F.greatest(F.abs(F.max(c) / last - 1), F.abs(F.min(c) / last - 1))


def _is_split(change: Column) -> Column:
    """Whether a factor step is a ratio of whole numbers with a denominator of 100 at most, other than 1."""
    near = lambda q: (F.round(change * q) != q) & (F.abs(F.round(change * q) / (q * change) - 1) <= FACTOR_TOLERANCE)
    return F.exists(F.sequence(F.lit(1), F.lit(LARGEST_DENOMINATOR)), near)


def certify_series(values: DataFrame, dividends: DataFrame, *more_keys: str) -> DataFrame:
    """Whether a ticker's generations tell the same series, the generation to keep, and the first reason against.

    ``values`` has ticker, generation, date, close and adjustment_factor; ``dividends`` has ticker, ex_date and
    cash_amount. Reasons in order: too few generations, repeated days or values that are null or not positive, pairs
    that share fewer than two days, closes or factors that differ after scaling to the last shared day, repeated
    ex-dates, ex-dates without a price on them and before, dividends above the price, factor steps that are neither
    dividend nor split, jumps of the raw close without a split. Generations of a ticker meet on the same day, and
    steps are lags within a generation. ``more_keys`` tell several sets of generations of a ticker apart.

    All windows and groups are parts of a ticker, and dividends come by the ticker, so values that are dealt out by ticker
    are not shuffled again; only a row for each of ``keys`` is.
    """
    keys = ["ticker", *more_keys]
    good = F.coalesce(valid_price(F.col("close")) & valid_price(F.col("adjustment_factor")) & F.col("date").isNotNull(), F.lit(False))
    rows = values.select(*keys, "generation", "date", "close", "adjustment_factor").withColumn("good", good)

    w = Window.partitionBy(*keys, "date")
    met = F.struct(F.col("generation").alias("g2"), F.col("close").alias("c2"), F.col("adjustment_factor").alias("f2"))
    shared = rows.where("good").withColumn("met", F.collect_list(met).over(w)).select("*", F.explode(F.filter("met", lambda x: x["g2"] > F.col("generation"))).alias("o"))
    pairs = shared.groupBy(*keys, "generation", "o.g2").agg(F.count(F.lit(1)).alias("n"), _off(F.col("close") / F.col("o.c2")).alias("close_off"), _off(F.col("adjustment_factor") / F.col("o.f2")).alias("factor_off"))
    agree = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least_shared"), F.max("close_off").alias("close_off"), F.max("factor_off").alias("factor_off"))

    paid = dividends.groupBy("ticker", "ex_date").agg(F.max("cash_amount").alias("cash"), F.count(F.lit(1)).alias("n"))
    paid = paid.groupBy("ticker").agg((F.sum("n") > F.count("ex_date")).alias("repeated_ex"), F.collect_list(F.when(F.col("ex_date").isNotNull(), F.struct("ex_date", "cash"))).alias("paid"))
    w = Window.partitionBy(*keys, "generation").orderBy(F.desc("good"), "date")  # bad rows come last, so no step starts at one
    step = lambda c: F.when(F.col("good"), c)
    raw = step(F.col("close") / F.col("adjustment_factor"))
    steps = rows.join(paid.select("ticker", F.map_from_entries("paid").alias("by_day")), "ticker", "left")
    steps = steps.withColumns({"raw": raw, "raw_before": F.lag(raw).over(w), "close_before": F.lag("close").over(w), "factor_before": F.lag("adjustment_factor").over(w), "day_before": F.lag("date").over(w), "cash": step(F.element_at("by_day", F.col("date")))})
    haircut = 1 - F.col("cash") / F.col("raw_before")
    expected = F.coalesce(F.when(haircut > 0, 1 / haircut), F.lit(1.0))
    steps = steps.withColumns({"change": step(F.col("adjustment_factor") / F.col("factor_before") / expected), "raw_change": step(F.col("raw") / F.col("raw_before")), "close_change": step(F.col("close") / F.col("close_before"))})
    moved = F.abs(F.col("change") - 1) > FACTOR_TOLERANCE
    split = moved & _is_split(F.col("change")) & (F.col("raw_change") * F.col("change")).between(0.5, 2) & F.col("close_change").between(0.5, 2)
    steps = steps.withColumns({"moved": moved, "split": split})
    gens = steps.groupBy(*keys, "generation").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"), F.max(~F.col("good") | F.coalesce(F.col("date") == F.col("day_before"), F.lit(False))).alias("invalid"),
        F.count_if(F.col("cash").isNotNull() & F.col("raw_before").isNotNull()).alias("placed"), F.max(F.col("cash").isNotNull() & ~F.coalesce(haircut > 0, F.lit(True))).alias("impossible"),
        F.max(F.coalesce(F.col("moved") & ~F.col("split"), F.lit(False))).alias("unexplained"), F.max(F.coalesce(((F.col("raw_change") <= 0.5) | (F.col("raw_change") >= 2)) & ~F.coalesce("split", F.lit(False)), F.lit(False))).alias("jump"), F.count_if("split").alias("splits"),
    ).join(paid, "ticker", "left")
    due = F.coalesce(F.size(F.filter("paid", lambda x: x["ex_date"].between(F.col("first"), F.col("last")))), F.lit(0))
    per = gens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fetches"), F.max(F.struct("last", "n", "generation"))["generation"].alias("keeper"), *(F.max(c).alias(c) for c in ("invalid", "impossible", "unexplained", "jump", "repeated_ex")),
        *(F.sum(c).alias(c) for c in ("placed", "splits")), F.sum(F.greatest(due, F.lit(0))).alias("due"))

    out = per.join(agree, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    every_pair = F.col("fetches") * (F.col("fetches") - 1) / 2
    tests = [
        ("fewer_than_two_generations", F.col("fetches") < 2), ("invalid_values", F.col("invalid")), ("too_few_shared_dates", (zero("pairs") < every_pair) | (zero("least_shared") < 2)),
        ("closes_disagree", F.col("close_off") > CLOSE_TOLERANCE), ("factors_disagree", F.col("factor_off") > FACTOR_TOLERANCE), ("repeated_ex_dates", F.col("repeated_ex")),
        ("dividend_without_prices", zero("due") > zero("placed")), ("impossible_dividend", F.col("impossible")), ("unexplained_factor_step", F.col("unexplained")), ("unexplained_raw_jump", F.col("jump")),
    ]
    reason = F.coalesce(*(F.when(c, n) for n, c in tests))
    return out.select(*keys, "keeper", "fetches", zero("splits").alias("splits"), reason.alias("reason"), reason.isNull().alias("certified"))


def rebaseline_plan(values: DataFrame, dividends: DataFrame, keepers: DataFrame) -> DataFrame:
    """Per ticker the generations that certify together with its keeper, and those that do not; keepers as (ticker, keeper)."""
    others = values.groupBy("ticker", "generation").agg(F.count(F.lit(1)).alias("n")).join(keepers, "ticker").groupBy("ticker", "keeper").agg(F.collect_list(F.when(F.col("generation") != F.col("keeper"), F.col("generation"))).alias("others"))
    own = F.col("generation") == F.col("keeper")
    sets = values.join(others, "ticker").withColumn("against", F.explode(F.when(own, F.col("others")).when(~own, F.array("generation"))))
    verdicts = certify_series(sets, dividends, "against")
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("against")))), ",")
    plan = verdicts.groupBy("ticker").agg(pick(F.col("certified")).alias("kept"), pick(~F.col("certified")).alias("deleted"))
    return keepers.join(plan, "ticker", "left").fillna("", ["kept", "deleted"])


def merge_price_refresh(new: DataFrame, old: DataFrame, eligible: DataFrame, tolerance: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Old prices with those new (ticker, date) that they lack, of eligible tickers whose shared days agree; and what was done per ticker.

    Nothing old is changed or goes, and merging twice adds nothing.
    """
    fresh = new.join(eligible.select("ticker").distinct(), "ticker", "left_semi")
    both = fresh.join(old.select("ticker", "date", F.col("close").alias("held")), ["ticker", "date"], "left")
    off = F.abs(F.col("held") - F.col("close")) / F.nullif(F.abs("close"), F.lit(0))
    report = both.groupBy("ticker").agg(F.count("held").alias("shared"), F.count_if(off > tolerance).alias("conflicts"), F.count_if(F.col("held").isNull()).alias("absent"))
    report = report.select("ticker", "shared", "conflicts", F.when(F.col("conflicts") > 0, 0).otherwise(F.col("absent")).alias("inserted"))
    added = both.where("held IS NULL").join(report.where("conflicts > 0"), "ticker", "left_anti").select("ticker", "date", "close")
    return old.select("ticker", "date", "close").unionByName(added), report


def refresh_states(new: DataFrame, old: DataFrame, states: DataFrame, eligible: DataFrame, generation: str, unresolved: DataFrame | None = None, tolerance: float = 0.001) -> DataFrame:
    """(ticker, served, comparability, alternate, reason) of refreshed tickers after a merge.

    Where shared days agree the new generation is served. Where they do not, or ``unresolved`` (ticker, reason) says so, the old one of ``states``
    (ticker, served) stays, unknown, with the new one as its alternate and the reason.
    """
    fresh = new.join(eligible.select("ticker").distinct(), "ticker", "left_semi")
    held = old.select("ticker", "date", F.col("close").alias("held"))
    off = F.abs(F.col("held") - F.col("close")) / F.nullif(F.abs("close"), F.lit(0))
    per = fresh.join(held, ["ticker", "date"], "left").groupBy("ticker").agg(F.count_if(off > tolerance).alias("rows"), F.max(off).alias("most"))
    told = F.format_string(f"price comparability unknown: %d overlaps exceed {tolerance * 100:g}%% (max %.5f%%)", "rows", F.col("most") * 100)
    per = per.withColumn("why", F.when(F.col("rows") > 0, told))
    if unresolved is not None:
        per = per.join(unresolved.select("ticker", F.col("reason").alias("__open")), "ticker", "left").withColumn("why", F.coalesce("why", "__open"))
    good = F.col("why").isNull()
    return per.join(states.select("ticker", F.col("served").alias("base")), "ticker", "left").select(
        "ticker", F.when(good, generation).otherwise(F.col("base")).alias("served"), F.when(good, "comparable").otherwise("unknown").alias("comparability"), F.when(~good, generation).alias("alternate"), F.col("why").alias("reason"))


def merge_dividends(new: DataFrame, old: DataFrame, eligible: DataFrame) -> DataFrame:
    """Old dividends with those new (ticker, ex_date) of eligible tickers that they lack; of several amounts the largest."""
    one = new.join(eligible.select("ticker").distinct(), "ticker", "left_semi").groupBy("ticker", "ex_date").agg(F.max("cash_amount").alias("cash_amount"))
    return old.select("ticker", "ex_date", "cash_amount").unionByName(one.join(old, ["ticker", "ex_date"], "left_anti"))


def refresh_missing(new: DataFrame, merged: DataFrame, states: DataFrame, eligible: DataFrame, new_dividends: DataFrame, merged_dividends: DataFrame) -> DataFrame:
    """(kind, ticker, date) that a refresh brought and the merged tables, read again, do not have; prices of unknown state are not meant to be there. Empty is verified."""
    mine = eligible.select("ticker").distinct()
    barred = states.where("comparability = 'unknown'").select("ticker")
    prices = new.join(mine, "ticker", "left_semi").join(barred, "ticker", "left_anti").select("ticker", "date").join(merged, ["ticker", "date"], "left_anti")
    dividends = new_dividends.join(mine, "ticker", "left_semi").select("ticker", "ex_date").distinct().join(merged_dividends, ["ticker", "ex_date"], "left_anti")
    return prices.select(F.lit("price").alias("kind"), "ticker", "date").union(dividends.select(F.lit("dividend"), "ticker", "ex_date"))


def outcome_labels(asks: DataFrame, values: DataFrame, state: DataFrame, days: DataFrame, horizon: int, entry_cost: float = 0.0, exit_cost: float = 0.0, benchmark: str = "SPY") -> DataFrame:
    """Return over the horizon after each (ticker, disclosure_date) on certified prices, that of the benchmark, and their difference, in percent.

    Costs are shares of the price, paid by both sides of a trade in the security and the benchmark. Where ticker or
    benchmark is not certified the status is ``uncertifiable``, where a quote is missing ``outcome_missing``, with the reason.
    """
    fine = state.where("comparable").select("ticker").distinct().withColumn("known", F.lit(True))
    spy = fine.where(F.col("ticker") == benchmark).agg(F.count(F.lit(1)).alias("bench_known"))
    ends = exact_endpoints(asks.withColumn("horizon", F.lit(horizon)), served_prices(values, state), days, benchmark).join(fine, "ticker", "left").crossJoin(F.broadcast(spy))  # one row
    bad = F.concat_ws("; ", F.when(F.col("known").isNull(), "ticker_not_certified"), F.when(F.col("bench_known") == 0, "benchmark_not_certified"))
    status = F.when(bad != "", "uncertifiable").when(F.col("reason").isNotNull(), "outcome_missing").otherwise("available")
    gain = lambda a, b: (F.col(b) * (1 - exit_cost) / (F.col(a) * (1 + entry_cost)) - 1) * 100
    ends = ends.withColumns({"status": status, "exclusion": F.when(bad != "", bad).otherwise(F.col("reason")), "fwd": gain("entry_price", "exit_price"), "bench": gain("bench_entry", "bench_exit")})
    there = lambda c: F.when(F.col("status") == "available", c)
    return ends.select(*asks.columns, "entry_date", "status", "exclusion", there(F.col("fwd")).alias("fwd"), there(F.col("bench")).alias("bench"), there(F.col("fwd") - F.col("bench")).alias("excess"))
