"""Who bought what, as known on a day: eligibility, symbols at a date, and distinct recent buyers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import NON_EQUITY_TICKERS, TICKER_FORM, canonical_member_key, classify_instrument, normalize_ticker

# Fixed values.
CONGRESS = ["house_pdf", "gemini_ocr", "senate_efd"]
OFFICIAL = [*CONGRESS, "form4", "13f"]
REJECTED_ORIGINS = ["invalid", "missing", "non_equity"]
NON_EQUITY_INSTRUMENTS = ["bond", "bonds", "call", "cash", "fund", "mutual fund", "note", "notes", "option", "put", "private", "stock option", "treasury"]
FLOOR, FLOOR_REASON = 1001.0, "purchase below PTR disclosure floor ($1,001)"
LOOKBACK_DAYS, MIN_BUYERS = 28, 3
# Descriptions of what is no equity: the first list in any case, the second unless a stock code stands by.
UNSUPPORTED = "mutual fund|index fund|exchange-traded fund|money market|treasury|government securit|corporate bond|municipal bond|real estate|cryptocurrency|private equity|limited partnership|stock\\s*option|option\\s*type"
UNSUPPORTED_TOO = "etf|bitcoin|btc|ethereum|litecoin|solana|ripple|xrp|usdc|ski\\s+mask\\s+dog|the\\s+graph|sui"
RENAMES = {"FB": ("META", "2022-06-09"), "SQ": ("XYZ", "2025-01-21"), "BLL": ("BALL", "2022-11-01"), "BK": ("BNY", "2026-04-10")}
ACQUISITIONS = {"ATVI": "2023-10-13", "CELG": "2019-11-20"}
LISTED_FROM = {"SPCX": "2026-06-12"}
CLASS_SHARES = {"BRK": "BRK-B", "BRKB": "BRK-B", "BRK.B": "BRK-B", "BRK.A": "BRK-A", "BF.B": "BF-B", "BF.A": "BF-A", "CWEN.A": "CWEN-A", "FOXA": "FOXA", "GOOG": "GOOG", "GOOGL": "GOOGL"}
PSEUDO = {"ROBL": "RBLX", "WARN": "WBD"}
QUARANTINED = ["SP", "ALLI", "MATT", "THE", "NEW", "MARY", "NORT", "CITI", "SOUT", "AMER", "BANK", "DEL", "MICH", "BERK", "WISC", "EAST", "FUND", "KING", "LAKE", "PORT", "TIPS"]


def disclosure_window(rows: DataFrame, as_of: Column, days: int | None = LOOKBACK_DAYS) -> DataFrame:
    """rows with a ticker, disclosed in the ``days`` up to as_of; None takes all history."""
    known = F.col("ticker").isNotNull() & (F.col("disclosure_date") <= as_of)
    return rows.where(known if days is None else known & (F.col("disclosure_date") >= F.date_sub(as_of, days)))


def as_of_cutoff(rows: DataFrame, as_of: Column) -> DataFrame:
    """disclosed by as_of; trades after it are cut, unknown trade dates stay."""
    return rows.where((F.col("disclosure_date") <= as_of) & (F.col("transaction_date").isNull() | (F.col("transaction_date") <= as_of)))


def eligible_equity(description: Column, source: Column, instrument: Column, origin: Column) -> Column:
    """equity of an official source; a stock code wins over the newer exclusions, not over the old ones."""
    d = F.lower(F.coalesce(description, F.lit("")))
    stock = d.contains("[st]")
    coin, vehicle = "\\b(?:bitcoin|btc|ethereum|ether|crypto(?:currency)?)\\b", "\\b(?:trust|etf|exchange[- ]traded fund)\\b"
    crypto = d.rlike(f"{coin}.{{0,48}}{vehicle}|{vehicle}.{{0,48}}{coin}|\\b(?:ibit|fbtc|ethe|gbtc)\\b")
    old, new = d.rlike(f"\\b(?:{UNSUPPORTED})\\b"), d.rlike(f"\\[(?:ct|cs|gs|ot)\\]|\\b(?:{UNSUPPORTED_TOO})\\b")
    bad = (
        F.lower(F.trim(origin)).isin(*REJECTED_ORIGINS)
        | ~F.lower(F.trim(source)).isin(*OFFICIAL)
        | F.lower(F.trim(instrument)).isin(*NON_EQUITY_INSTRUMENTS)
    )
    return ~F.coalesce(bad, F.lit(False)) & ~(stock & crypto) & ~old & ~(new & ~stock) & (classify_instrument(d) != "private") & ~(d.contains("[op]") & ~stock)


def below_floor_reason(source: Column, kind: Column, amount: Column) -> Column:
    """why a purchase of a member of congress is too small to be a report; else null."""
    return F.when(F.lower(F.trim(source)).isin(*CONGRESS) & (F.lower(F.trim(kind)) == "purchase") & (amount > 0) & (amount < FLOOR), FLOOR_REASON)


def valid_chronology(rows: DataFrame) -> DataFrame:
    """both dates known, and the trade not after its disclosure."""
    return rows.where(F.col("transaction_date") <= F.col("disclosure_date"))


def resolver_dimension(spark: SparkSession) -> DataFrame:
    """The symbols that are not taken as they are: raw, rule, mapped, since, family."""
    rows = [(t, "quarantined", None, None, t) for t in QUARANTINED]
    rows += [(t, "listing", None, day, t) for t, day in LISTED_FROM.items()]
    rows += [(t, "class_share", to, None, to) for t, to in CLASS_SHARES.items()]
    rows += [(t, "rename", to, day, to) for t, (to, day) in RENAMES.items()]
    rows += [(t, "acquisition", None, day, t) for t, day in ACQUISITIONS.items()]
    rows += [(t, "pseudo", to, None, to) for t, to in PSEUDO.items()]
    return spark.createDataFrame(rows, "raw string, rule string, mapped string, since string, rule_family string").withColumn("since", F.to_date("since"))


def resolve_tickers(rows: DataFrame, raw: str, on: Column) -> DataFrame:
    """Adds symbol, symbol_status, symbol_confidence and family of a raw symbol at a date.

    The rules are a few dozen rows, told by one broadcast join. Null dates are not known dates.
    """
    dim = F.broadcast(resolver_dimension(rows.sparkSession))
    out = rows.withColumn("__raw", normalize_ticker(F.col(raw))).withColumn("__on", on).join(dim, F.col("__raw") == F.col("raw"), "left")
    rule, since, at = F.col("rule"), F.col("since"), F.col("__on")
    status = (
        F.when(F.col("__raw").isNull(), "unresolved")
        .when(rule.isNull(), "unverified")
        .when(rule.isin("quarantined", "class_share", "pseudo"), rule)
        .when(at.isNull(), F.when(rule == "rename", "unverified").otherwise("date_required"))
        .when(rule == "listing", F.when(since > at, "pre_listing").otherwise("listed_from_date"))
        .when(rule == "rename", F.when(since <= at, "renamed").otherwise("pre_rename"))
        .otherwise(F.when(since >= at, "pre_acquisition").otherwise("acquired"))
    )
    out = out.withColumn("symbol_status", status)
    mapped = F.when(F.col("symbol_status").isin("class_share", "pseudo", "renamed"), F.col("mapped")).otherwise(F.col("__raw"))
    sure = F.when(F.col("symbol_status").isin("listed_from_date", "class_share", "renamed", "pre_rename", "pre_acquisition"), 1.0).when(F.col("symbol_status") == "pseudo", 0.8).otherwise(0.0)
    return out.withColumns({"symbol": mapped, "symbol_confidence": sure, "family": F.coalesce("rule_family", "__raw")}).drop("__raw", "__on", "raw", "rule", "mapped", "since", "rule_family")


def eligible_purchases(rows: DataFrame, sources: list[str] = CONGRESS, below_floor: bool = False) -> DataFrame:
    """C2 without the buyer: eligible purchases with symbol and family. ``below_floor`` keeps those with a floor_reason."""
    buys = valid_chronology(rows.where((F.col("transaction_type") == "Purchase") & F.col("source").isin(*sources)))
    buys = buys.where(eligible_equity(F.col("asset_description"), F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    floor = below_floor_reason(F.col("source"), F.col("transaction_type"), F.col("amount_midpoint"))
    buys = buys.withColumn("floor_reason", floor) if below_floor else buys.where(floor.isNull())
    t = normalize_ticker(F.col("ticker"))
    buys = resolve_tickers(buys.where(t.rlike(TICKER_FORM) & ~t.isin(*NON_EQUITY_TICKERS)), "ticker", F.col("transaction_date"))
    return buys.where(~F.col("symbol_status").isin("unresolved", "quarantined", "acquired", "date_required", "pre_listing"))


def prepare_purchases(rows: DataFrame, sources: list[str] = CONGRESS, below_floor: bool = False) -> DataFrame:
    """Eligible purchases with symbol, family and buyer; '' is a buyer that is not known."""
    return eligible_purchases(rows, sources, below_floor).withColumn("buyer", canonical_member_key(F.col("member")))


def _counted_purchases(rows: DataFrame, *keys: str) -> DataFrame:
    """Eligible purchases counted per family, ``keys``, buyer (null: not known) and lag. Names are counted as filed first, so a name's key is worked out once and not per row."""
    lag = F.datediff("disclosure_date", "transaction_date")
    filed = eligible_purchases(rows).groupBy("family", *keys, "member", lag.alias("lag")).agg(F.count(F.lit(1)).alias("rows"), F.max("disclosure_date").alias("newest"), F.min("transaction_date").alias("oldest"))
    key = canonical_member_key(F.col("member"))
    return filed.withColumn("buyer", F.when(key != "", key)).drop("member")


def _score(counted: DataFrame, keys: list[str], min_buyers: int) -> DataFrame:
    """Per group the distinct buyers, the first three of them, and lags by their counts: one partial aggregate, without a distinct count."""
    out = counted.groupBy(*keys).agg(F.array_sort(F.collect_set("buyer")).alias("__b"), F.max("lag").alias("max_lag"), F.percentile("lag", 0.5, F.col("rows")).alias("median_lag"), F.max("newest").alias("latest_disclosure_date"), F.min("oldest").alias("oldest_transaction_date"))
    n = F.size("__b").cast("long")
    return out.select(
        *keys, n.alias("num_buyers"), F.array_join(F.slice("__b", 1, 3), ", ").alias("buyers"), "max_lag", "median_lag", "latest_disclosure_date", "oldest_transaction_date", F.when(n >= min_buyers, n.cast("double")).otherwise(0.0).alias("signal_score"))


def distinct_buyer_score(rows: DataFrame, as_of: Column, days: int = LOOKBACK_DAYS, min_buyers: int = MIN_BUYERS) -> DataFrame:
    """Per security family the distinct buyers disclosed in the window; too few score 0."""
    return _score(_counted_purchases(disclosure_window(rows, as_of, days)).withColumnRenamed("family", "ticker"), ["ticker"], min_buyers)


def consensus_candidates(rows: DataFrame, as_of: Column, days: int = LOOKBACK_DAYS, min_buyers: int = 1) -> DataFrame:
    """Families with enough distinct buyers in the window."""
    return distinct_buyer_score(rows, as_of, days, min_buyers).where(F.col("num_buyers") >= min_buyers).select("ticker", "num_buyers")


def consensus_over_dates(rows: DataFrame, dates: DataFrame, days: int = LOOKBACK_DAYS, step: int = 7, min_buyers: int = MIN_BUYERS) -> DataFrame:
    """The same for decision dates a fixed ``step`` apart: each row goes to the dates that see it, by arithmetic.

    ``dates``: one row of first and last decision date.
    """
    bought = _counted_purchases(rows, "disclosure_date")
    bought = bought.crossJoin(F.broadcast(dates))  # of one row
    first = F.greatest(F.lit(0), F.ceil(F.datediff("disclosure_date", "first") / step)).cast("int")
    last = F.least(F.floor(F.datediff("last", "first") / step), F.floor((F.datediff("disclosure_date", "first") + days) / step)).cast("int")
    seen = bought.where(first <= last).withColumn("n", F.explode(F.sequence(first, last))).withColumn("as_of", F.expr(f"date_add(first, n * {step})"))
    # A window holds at most ``days`` days of disclosure, so the lags of a group are a short list with counts.
    per = seen.groupBy("as_of", F.col("family").alias("ticker"), "buyer", "lag").agg(F.sum("rows").alias("rows"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest"))
    return _score(per, ["as_of", "ticker"], min_buyers).where(F.col("num_buyers") >= min_buyers)


def rank_recommendations(scored: DataFrame, n: int, date: str | None = None) -> DataFrame:
    """K1: by score, then ticker; the first n overall, or of each decision date."""
    if date is None:
        return scored.orderBy(F.desc("signal_score"), "ticker").limit(n)
    w = Window.partitionBy(date).orderBy(F.desc("signal_score"), "ticker")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def buyers_table(rows: DataFrame) -> DataFrame:
    """Per symbol and buyer the number of purchases, first and last disclosure, and sources in order."""
    return prepare_purchases(rows).where("buyer != ''").groupBy("symbol", "buyer").agg(F.count(F.lit(1)).alias("purchases"), F.min("disclosure_date").alias("first_disclosed"), F.max("disclosure_date").alias("last_disclosed"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def source_coverage(rows: DataFrame, as_of: Column, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Per chamber the newest disclosure, rows in the window, age and state; both chambers always appear."""
    known = rows.where(F.col("disclosure_date") <= as_of).groupBy("chamber").agg(F.max("disclosure_date").alias("latest"), F.count_if(F.col("disclosure_date") >= F.date_sub(as_of, days)).alias("in_window"))
    chambers = rows.sparkSession.createDataFrame([("house",), ("senate",)], "chamber string")
    out = chambers.join(known, "chamber", "left").withColumn("age", F.datediff(as_of, "latest")).withColumn("in_window", F.coalesce("in_window", F.lit(0)))
    return out.withColumn("state", F.when(F.col("latest").isNull(), "missing").when(F.col("age") <= days, "in").otherwise("outside"))


def recent_active_tickers(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    """symbols disclosed near a day."""
    return disclosure_window(rows, as_of, days).select("ticker").distinct()


def price_universe(rows: DataFrame) -> DataFrame:
    """every raw symbol once, with the reason why it has no prices, if so."""
    t = normalize_ticker(F.col("ticker"))
    reason = F.when(t.isNull(), "missing").when(~t.rlike(TICKER_FORM), "syntax").when(t.isin(*NON_EQUITY_TICKERS), "reserved").when(t.isin(*QUARANTINED), "quarantined").when(t.isin(*ACQUISITIONS), "retired").when(t.isin(*RENAMES), "renamed")
    return rows.select(t.alias("symbol"), reason.alias("reason")).distinct()
