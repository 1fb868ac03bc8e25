"""Prices at exact sessions and as of a day: endpoints, paths, labels, coverage. Prices stay long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .consensus import resolve_tickers

BENCHMARK = "SPY"
DECAY = 0.005
#: Days of a bucket that range joins meet in.
BUCKET = 32


def valid_price(c: Column) -> Column:
    """positive and finite."""
    return (c > 0) & ~F.isnan(c) & (c < float("inf"))


def read_prices(prices: DataFrame, tickers: DataFrame, first: Column, last: Column) -> DataFrame:
    """Valid closes of listed tickers between two days."""
    return prices.where(F.col("date").between(first, last) & valid_price(F.col("close"))).join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def prices_wide_to_long(wide: DataFrame, key: str = "date") -> DataFrame:
    """A column per ticker to a row per ticker and day; invalid closes go."""
    names = [c for c in wide.columns if c != key]
    return wide.unpivot([key], names, "ticker", "close").where(valid_price(F.col("close")))


def session_days(sessions: DataFrame) -> DataFrame:
    """For every calendar day the last session on or before it and the first one after it.

    A calendar is a few thousand days, and bounded by its range: its window is one small task.
    """
    w = Window.orderBy("session_date")
    spans = sessions.select("session_date", F.lead("session_date").over(w).alias("next_session")).where("next_session is not null")
    return spans.select(F.explode(F.sequence("session_date", F.date_sub("next_session", 1))).alias("day"), F.col("session_date").alias("prev_session"), "next_session")


def exchange_closed(d: Column) -> Column:
    """Weekends and holidays, by rule: fixed days moved off weekends, nth weekdays, Good Friday, two one-off days."""
    y, m, dom, dow = F.year(d), F.month(d), F.dayofmonth(d), F.dayofweek(d)  # Sunday is 1

    def nth(month: int, weekday: int, n: int) -> Column:
        return (m == month) & (dow == weekday) & (F.ceil(dom / 7) == n)

    def observed(month: int, day: int, saturday: bool = True) -> Column:
        exact = (m == month) & (dom == day)
        monday = (dow == 2) & (F.month(F.date_sub(d, 1)) == month) & (F.dayofmonth(F.date_sub(d, 1)) == day)
        friday = (dow == 6) & (F.month(F.date_add(d, 1)) == month) & (F.dayofmonth(F.date_add(d, 1)) == day)
        return exact | monday | friday if saturday else exact | monday

    a, b, c = y % 19, F.floor(y / 100), y % 100
    h = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7
    z = F.floor((a + 11 * h + 22 * k) / 451)
    n = h + k - 7 * z + 114
    good_friday = F.date_sub(F.make_date(y, F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int")), 2)
    return (
        dow.isin(1, 7) | observed(1, 1, saturday=False) | nth(1, 2, 3) | nth(2, 2, 3) | (d == good_friday) | ((m == 5) & (dow == 2) & (dom > 24))
        | ((y >= 2022) & observed(6, 19)) | observed(7, 4) | nth(9, 2, 1) | nth(11, 5, 4) | observed(12, 25) | d.isin("2018-12-05", "2025-01-09")
    )


def exchange_sessions(first: str, last: str, spark) -> DataFrame:
    """The days from first to last on which the exchange is open."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS session_date")
    return days.where(~exchange_closed(F.col("session_date")))


def exact_endpoints(rows: DataFrame, prices: DataFrame, days: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """Entry at the first session after disclosure, exit at the last session within the horizon, or nothing.

    ``rows`` has ticker, disclosure_date and horizon. Security and benchmark must quote exactly on both
    days; what is missing first is the reason. Four equality joins; the calendar and the benchmark are small.
    """
    first = rows.join(days.select(F.col("day").alias("disclosure_date"), F.col("next_session").alias("entry_date")), "disclosure_date", "left")
    both = first.withColumn("window_end", F.expr("date_add(entry_date, horizon)")).join(days.select(F.col("day").alias("window_end"), F.col("prev_session").alias("exit_date")), "window_end", "left")
    good = prices.where(valid_price(F.col("close")))

    def quotes(df: DataFrame, day: str, name: str) -> DataFrame:
        return df.select("ticker", F.col("date").alias(day), F.col("close").alias(name))

    bench = good.where(F.col("ticker") == benchmark).drop("ticker")
    out = both.join(quotes(good, "entry_date", "entry_price"), ["ticker", "entry_date"], "left").join(quotes(good, "exit_date", "exit_price"), ["ticker", "exit_date"], "left")
    for day, name in (("entry_date", "bench_entry"), ("exit_date", "bench_exit")):
        out = out.join(bench.select(F.col("date").alias(day), F.col("close").alias(name)), day, "left")
    reason = F.when(F.col("entry_price").isNull(), "entry_quote_unavailable").when(F.col("exit_price").isNull(), "exit_quote_unavailable").when(F.col("bench_entry").isNull() | F.col("bench_exit").isNull(), "benchmark_quote_unavailable")
    return out.withColumn("reason", reason)


def with_returns(endpoints: DataFrame) -> DataFrame:
    """Total return and alpha in percent over exact endpoints; null where any is missing."""
    total = (F.col("exit_price") / F.col("entry_price") - 1) * 100
    bench = (F.col("bench_exit") / F.col("bench_entry") - 1) * 100
    return endpoints.withColumns({"total_return": F.when(F.col("reason").isNull(), total), "alpha": F.when(F.col("reason").isNull(), total - bench)})


def explode_horizons(rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """A row for each horizon in days."""
    return rows.withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons))))


def price_asof(keys: DataFrame, prices: DataFrame, forward: bool = False, most_days: int | None = None, valid: bool = True) -> DataFrame:
    """Per (ticker, day) the last quote on or before the day, or the first on or after it, with its gap in days.

    Keys and quotes are laid in one order per ticker and year and the quote is carried along; what earlier (or later)
    years end with comes in from a table of one row per ticker and year. No range join, and no task holds more than
    a year of a ticker. ``most_days`` turns farther quotes to null. Repeated keys are kept. Without ``valid`` any value that is not null is a quote.
    """
    quotes = prices.where(valid_price(F.col("close")) if valid else F.col("close").isNotNull()).select("ticker", F.col("date").alias("at"), F.struct("date", "close").alias("q"), F.lit(0).alias("k"))
    asked = keys.select("ticker", F.col("day").alias("at"), F.lit(None).cast("struct<date:date,close:double>").alias("q"), F.lit(1).alias("k"))
    order = F.desc("at") if forward else F.asc("at")  # a quote comes before the keys of its day
    w = Window.partitionBy("ticker", "year").orderBy(order, "k").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.union(quotes).withColumn("year", F.year("at"))
    ends = rows.groupBy("ticker", "year").agg((F.min("q") if forward else F.max("q")).alias("end"))
    years = Window.partitionBy("ticker").orderBy(F.desc("year") if forward else F.asc("year")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("ticker", "year", F.last("end", ignorenulls=True).over(years).alias("carried"))
    rows = rows.withColumn("found", F.last("q", ignorenulls=True).over(w)).where("k = 1").join(carried, ["ticker", "year"], "left").withColumn("found", F.coalesce("found", "carried"))
    gap = F.datediff("found.date", "at") if forward else F.datediff("at", "found.date")
    near = F.lit(True) if most_days is None else gap <= most_days
    return rows.select("ticker", F.col("at").alias("day"), *(F.when(near, c).alias(n) for n, c in (("quote_date", F.col("found.date")), ("quote", F.col("found.close")), ("gap", gap))))


def price_nearest(keys: DataFrame, prices: DataFrame, tolerance: int) -> DataFrame:
    """The nearest quote within ``tolerance`` days either way; of two as near the earlier."""
    keys = keys.distinct()
    back, ahead = price_asof(keys, prices, most_days=tolerance), price_asof(keys, prices, forward=True, most_days=tolerance)
    both = back.join(ahead.select("ticker", "day", F.col("quote_date").alias("d2"), F.col("quote").alias("q2"), F.col("gap").alias("g2")), ["ticker", "day"])
    earlier = F.col("g2").isNull() | (F.col("gap") <= F.col("g2"))
    return both.select("ticker", "day", F.when(earlier, F.col("quote_date")).otherwise(F.col("d2")).alias("quote_date"), F.when(earlier, F.col("quote")).otherwise(F.col("q2")).alias("quote"))


def price_path(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Every quote of a row's ticker from entry_date to exit_date: an equality join on ticker and day bucket."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / BUCKET)
    spans = rows.withColumn("bucket", F.explode(F.sequence(bucket(F.col("entry_date")), bucket(F.col("exit_date")))))
    quotes = prices.where(valid_price(F.col("close"))).withColumn("bucket", bucket(F.col("date")))
    return spans.join(quotes, ["ticker", "bucket"]).where(F.col("date").between(F.col("entry_date"), F.col("exit_date"))).drop("bucket")


def decay_weighted_log_mean(path: DataFrame, keys: list[str], decay: float = DECAY) -> DataFrame:
    """The mean log step of security and benchmark over the days that both have, weights halving at the step's middle, in percent.

    ``path`` has keys, date, entry_date, close and bench (null on days without the benchmark); fewer than two
    common days give null.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    d = F.datediff("date", "entry_date")
    steps = path.where("bench IS NOT NULL").withColumn("weight", F.exp(-decay * (d + F.lag(d).over(w)) / 2))
    steps = steps.withColumns({"own": F.log(F.col("close") / F.lag("close").over(w)), "other": F.log(F.col("bench") / F.lag("bench").over(w))})
    mean = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight") * 100
    out = steps.groupBy(*keys).agg(mean("own").alias("decayed_return"), mean("other").alias("decayed_bench"))
    return out.withColumn("decayed_alpha", F.col("decayed_return") - F.col("decayed_bench"))


def signal_labels(rows: DataFrame, prices: DataFrame, days: DataFrame, key: str, horizons: Sequence[int] = (30, 90), benchmark: str = BENCHMARK, decay: float = DECAY) -> DataFrame:
    """W12 (with W11, N24, N35): entry, exit, peak, trough, return, alpha and decayed means per row and horizon.

    Peak and trough are those of the security's own window; decayed means are over days that the benchmark has too.
    """
    ends = with_returns(exact_endpoints(explode_horizons(rows, horizons), prices, days, benchmark))
    # A row's path is taken once, to its last complete horizon; each horizon's figures are of the quotes up to its own exit.
    exits = [F.max(F.when(F.col("horizon") == h, F.col("exit_date"))).alias(f"exit_{h}") for h in horizons]
    done = ends.where("reason is null").groupBy(key, "ticker", "entry_date").agg(*exits, F.max("exit_date").alias("exit_date"))
    bench = prices.where((F.col("ticker") == benchmark) & valid_price(F.col("close"))).select("date", F.col("close").alias("bench"))
    path = price_path(done, prices).join(bench, "date", "left")
    # Days without the benchmark are a partition of their own, so one shuffle serves both kinds of figures.
    common = F.col("bench").isNotNull()
    w = Window.partitionBy(key, common).orderBy("date")
    d = F.datediff("date", "entry_date")
    path = path.withColumns({"weight": F.when(common, F.exp(-decay * (d + F.lag(d).over(w)) / 2)), "own": F.log(F.col("close") / F.lag("close").over(w)), "other": F.log(F.col("bench") / F.lag("bench").over(w))})
    figures = []
    for h in horizons:
        inside = lambda c, h=h: F.when(F.col("date") <= F.col(f"exit_{h}"), c)
        mean = lambda c, inside=inside: F.sum(inside(F.col(c) * F.col("weight"))) / F.sum(inside(F.col("weight"))) * 100
        figures.append(F.struct(F.lit(h).alias("horizon"), F.max(inside(F.col("close"))).alias("peak"), F.min(inside(F.col("close"))).alias("trough"), mean("own").alias("decayed_return"), mean("other").alias("decayed_bench")))
    shape = path.groupBy(key).agg(F.array(*figures).alias("f")).select(key, F.explode("f").alias("f")).select(key, "f.*").where("peak IS NOT NULL")
    return ends.join(shape, [key, "horizon"], "left").withColumns({"complete": F.col("reason").isNull(), "decayed_alpha": F.col("decayed_return") - F.col("decayed_bench")})


def completed_horizon(labels: DataFrame, horizon: int, kind: str | None = None) -> DataFrame:
    """labels of one horizon, of one type of trade if stated, whose window is complete."""
    out = labels.where((F.col("horizon") == horizon) & F.coalesce("complete", F.lit(False)))
    return out if kind is None else out.where(F.col("transaction_type") == kind)


def entry_prices(rows: DataFrame, prices: DataFrame, days: DataFrame) -> DataFrame:
    """The close at the first session after disclosure, of the symbol that the raw one stood for then (J17), else of the raw one; rows with neither go.

    ``rows``: ticker, transaction_date and disclosure_date. What was acquired, not listed yet or cannot be told without a date has no
    entry, nor has a trade after its disclosure. Equality joins through the calendar.
    """
    sound = rows.where(F.col("ticker").isNotNull() & (F.col("transaction_date").isNull() | (F.col("transaction_date") <= F.col("disclosure_date"))))
    told = resolve_tickers(sound, "ticker", F.col("disclosure_date")).where(~F.col("symbol_status").isin("acquired", "date_required", "pre_listing")).drop("symbol_status", "symbol_confidence", "family")
    at = told.join(days.select(F.col("day").alias("disclosure_date"), F.col("next_session").alias("entry_date")), "disclosure_date")
    good = prices.where(valid_price(F.col("close"))).groupBy("ticker", "date").agg(F.max("close").alias("close"))

    def quotes(symbol: str, name: str) -> DataFrame:
        return good.select(F.col("ticker").alias(symbol), F.col("date").alias("entry_date"), F.col("close").alias(name))

    out = at.join(quotes("symbol", "__own"), ["symbol", "entry_date"], "left").join(quotes("ticker", "__raw"), ["ticker", "entry_date"], "left")
    return out.withColumn("entry_price", F.coalesce("__own", "__raw")).withColumn("entry_symbol", F.when(F.col("__own").isNotNull(), F.col("symbol")).otherwise(F.col("ticker"))).where("entry_price IS NOT NULL").drop("__own", "__raw")


def adjusted_filed_price(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """A filed price times the latest adjustment factor of the served generation on or before its day; else blocked, with the reason.

    ``rows`` has ticker, day and filed; ``factors`` has ticker, date and factor. The latest known factor counts: where it is not
    valid, no older one takes its place.
    """
    known = factors.select("ticker", "date", F.col("factor").alias("close"))
    at = price_asof(rows.select("ticker", "day").distinct(), known, valid=False).select("ticker", "day", F.col("quote").alias("factor"))
    out = rows.join(at, ["ticker", "day"], "left")
    reason = F.when(~F.coalesce(F.col("filed") > 0, F.lit(False)), "no_filed_price").when(F.col("factor").isNull(), "no_adjustment_factor").when(~valid_price(F.col("factor")), "invalid_adjustment_factor")
    return out.withColumns({"adjusted": F.when(reason.isNull(), F.col("filed") * F.col("factor")), "blocked": reason})


def step_changes(prices: DataFrame) -> DataFrame:
    """Each close over the one before it."""
    w = Window.partitionBy("ticker").orderBy("date")
    return prices.select("ticker", "date", (F.col("close") / F.lag("close").over(w)).alias("step"))


def price_coverage(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per ticker first and last day, days, and sessions between them without a price."""
    spans = prices.where(valid_price(F.col("close"))).groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("days"))
    w = Window.orderBy("session_date")
    place = sessions.select("session_date", F.row_number().over(w).alias("i"))
    out = spans.join(place.select(F.col("session_date").alias("first_date"), F.col("i").alias("i0")), "first_date").join(place.select(F.col("session_date").alias("last_date"), F.col("i").alias("i1")), "last_date")
    return out.select("ticker", "first_date", "last_date", "days", (F.col("i1") - F.col("i0") + 1 - F.col("days")).alias("missing"))


def missing_sessions(prices: DataFrame, sessions: DataFrame, spans: DataFrame) -> DataFrame:
    """Sessions without a valid price between a ticker's first_date and last_date: its days meet the calendar by equality."""
    days = spans.select("ticker", F.explode(F.sequence("first_date", "last_date")).alias("date"))
    wanted = days.join(sessions.select(F.col("session_date").alias("date")), "date")
    return wanted.join(prices.where(valid_price(F.col("close"))), ["ticker", "date"], "left_anti").select("ticker", "date")


def stale_series(prices: DataFrame, as_of: Column, most_days: int) -> DataFrame:
    """Tickers whose last close is older than ``most_days``."""
    return prices.where(F.col("date") <= as_of).groupBy("ticker").agg(F.max("date").alias("last_date")).withColumn("age", F.datediff(as_of, "last_date")).where(F.col("age") > most_days)


def series_divergence(a: DataFrame, b: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Per ticker shared days, largest relative difference, and whether the series can be merged."""
    both = a.select("ticker", "date", F.col("close").alias("x")).join(b.select("ticker", "date", F.col("close").alias("y")), ["ticker", "date"], "full_outer")
    gap = F.abs(F.col("x") - F.col("y")) / F.abs(F.col("y"))
    out = both.groupBy("ticker").agg(F.count(gap).alias("overlap"), F.max(gap).alias("max_gap"), F.count(F.lit(1)).alias("merged_days"))
    return out.withColumn("verdict", F.when(F.col("overlap") == 0, "unknown").when(F.col("max_gap") <= tolerance, "comparable").otherwise("divergent"))


def coalesce_series(new: DataFrame, old: DataFrame) -> DataFrame:
    """Incoming closes over old ones, days of both kept."""
    both = new.select("ticker", "date", F.col("close").alias("x")).join(old.select("ticker", "date", F.col("close").alias("y")), ["ticker", "date"], "full_outer")
    return both.select("ticker", "date", F.coalesce("x", "y").alias("close"))


def series_hash(prices: DataFrame) -> DataFrame:
    """SHA-256 per ticker over its (date, close) lines in the order of days; closes as whole thirty-seconds."""
    line = F.concat_ws("=", F.col("date").cast("string"), F.round(F.col("close") * 32).cast("long").cast("string"))
    return prices.groupBy("ticker").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("series_sha256"))


def ex_dividend_block(decisions: DataFrame, dividends: DataFrame, days: int = 7) -> DataFrame:
    """Decisions with an ex-date in the ``days`` up to them, with the latest such date: ticker and day bucket meet, not tickers."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / BUCKET)
    asked = decisions.withColumn("bucket", F.explode(F.sequence(bucket(F.date_sub("day", days)), bucket(F.col("day")))))
    near = asked.join(dividends.withColumn("bucket", bucket(F.col("ex_date"))), ["ticker", "bucket"]).where((F.col("ex_date") <= F.col("day")) & (F.col("ex_date") > F.date_sub("day", days)))
    return near.groupBy("ticker", "day").agg(F.max("ex_date").alias("ex_date"))
