"""Fills of a broker's blotter: first-in-first-out profit by running sums over blocks of days, and what others bought before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import poisson_base_rate

# Fixed values.
OPENS, CLOSES, LONG = ["BTO", "STO"], ["STC", "BTC"], ["BTO", "STC"]
MATCH_DAYS, REPORT_DAYS = 60, [30, 45, 60, 90]
#: Days of a symbol's fills that are one block of the running sums.
BLOCK_DAYS = 16


def matched_fills(fills: DataFrame, key: str, day: str, order: list[str]) -> DataFrame:
    """Fills with ``closed``, the quantity that a close takes from what is open, and ``left``, what is still open of an opening.

    ``fills``: key, side (BTO and STC, STO and BTC), qty (positive), price, day and order columns. Long and short are two books of a symbol. The
    open quantity is a running sum reflected at zero: a sum and the least sum so far, which can be put together block by block, so a block of days
    is the most that a task holds of a symbol, and a row per block the most that is ordered over all its time. What a close asks beyond the
    open quantity falls away at that moment and never meets a later opening. As the first opened is closed first, an opening is left over
    as far as its end in the order of openings lies beyond all that was closed; no intervals are joined.
    """
    keys = [key, "book"]
    opens = F.col("side").isin(*OPENS)
    rows = fills.where(F.col("side").isin(*OPENS, *CLOSES) & (F.col("qty") > 0)).withColumns({"book": F.when(F.col("side").isin(*LONG), "long").otherwise("short"), "__block": F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BLOCK_DAYS)})
    rows = rows.withColumns({"__x": F.when(opens, F.col("qty")).otherwise(-F.col("qty")), "__o": F.when(opens, F.col("qty")).otherwise(0.0)})
    w = Window.partitionBy(*keys, "__block").orderBy(day, *order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"__s": F.sum("__x").over(upto), "__b": F.sum("__o").over(upto)}).withColumn("__low", F.min("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = local.groupBy(*keys, "__block").agg(F.sum("__x").alias("s"), F.min("__s").alias("low"), F.sum("__o").alias("b"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"s0": F.coalesce(F.sum("s").over(earlier), F.lit(0.0)), "b0": F.coalesce(F.sum("b").over(earlier), F.lit(0.0))})
    blocks = blocks.withColumn("low0", F.least(F.lit(0.0), F.min(F.col("s0") + F.col("low")).over(earlier))).select(*keys, "__block", "s0", "b0", "low0")
    run = local.join(blocks, [*keys, "__block"])
    before, now = F.least("low0", F.col("s0") + F.col("__low")), F.col("s0") + F.col("__s")
    beyond = F.greatest(F.lit(0.0), before - now)
    run = run.withColumn("closed", F.when(~opens, F.col("qty") - beyond)).withColumn("__end", F.when(opens, F.col("b0") + F.col("__b")))
    gone = run.groupBy(*keys).agg(F.coalesce(F.sum("closed"), F.lit(0.0)).alias("__gone"))
    run = run.join(gone, keys)
    return run.withColumn("left", F.when(opens, F.greatest(F.lit(0.0), F.least(F.col("qty"), F.col("__end") - F.col("__gone"))))).select(*fills.columns, "book", "closed", "left")


def fills_fifo(matched: DataFrame, key: str) -> DataFrame:
    """Per key closed quantity, realised profit, open quantity (short is negative), its average entry if long, and closes that asked too much.

    ``matched``: of ``matched_fills``.
    """
    sign = F.when(F.col("book") == "long", 1.0).otherwise(-1.0)
    used = F.when(F.col("left").isNotNull(), F.col("qty") - F.col("left"))
    open_qty, over = F.coalesce(F.sum(sign * F.col("left")), F.lit(0.0)), F.col("closed") < F.col("qty")
    out = matched.groupBy(key).agg(
        F.coalesce(F.sum("closed"), F.lit(0.0)).alias("matched"), F.sum(sign * (F.coalesce(F.col("closed") * F.col("price"), F.lit(0.0)) - F.coalesce(used * F.col("price"), F.lit(0.0)))).alias("realised"),
        open_qty.alias("open_qty"), F.sum(sign * F.col("left") * F.col("price")).alias("__cost"), F.count_if(over).alias("over_closes"), F.coalesce(F.sum(F.when(over, F.col("qty") - F.col("closed"))), F.lit(0.0)).alias("discarded"),
    )
    return out.withColumn("open_entry", F.when(F.col("open_qty") > 0, F.col("__cost") / F.col("open_qty")).otherwise(0.0)).drop("__cost")


def over_closes(matched: DataFrame) -> DataFrame:
    """The closes that asked for more than was open, and by how much."""
    return matched.where("closed < qty").withColumn("excess", F.col("qty") - F.col("closed"))


def blotter_report(matched: DataFrame, trades: DataFrame, quotes: DataFrame, key: str = "ticker", day: str = "date", windows: list[int] = REPORT_DAYS, match_days: int = MATCH_DAYS) -> DataFrame:
    """Per symbol position, profit, and the purchases of members before its first BTO, in several windows and against chance.

    ``trades``: ticker, member, transaction_date, disclosure_date, transaction_type; the same trade disclosed twice the same day counts once.
    ``quotes``: ticker, price. A trade is dated by its transaction, else its disclosure. One row per symbol is all that meets the trades: the first buy is
    told by an aggregate, and the windows are conditions of the next one.
    """
    side = F.col("side")
    value, qty = F.col("price") * F.col("qty"), F.col("qty")
    base = matched.groupBy(key).agg(
        F.count(F.lit(1)).alias("fills"), F.min(F.when(side == "BTO", F.col(day))).alias("first_buy"), *(F.sum(F.when(side.isin(*s), x)).alias(n) for s, x, n in ((OPENS, value, "__oc"), (OPENS, qty, "__oq"), (CLOSES, value, "__cc"), (CLOSES, qty, "__cq"))))
    base = base.join(fills_fifo(matched, key), key).join(quotes.select(F.col("ticker").alias(key), F.col("price").alias("current")), key, "left")
    one = trades.select(F.col("ticker").alias(key), "member", "transaction_date", "disclosure_date", "transaction_type").distinct()
    dated = one.withColumns({"on": F.coalesce("transaction_date", "disclosure_date"), "buy": F.lower(F.trim("transaction_type")) == "purchase"}).join(base.select(key, "first_buy"), key)
    ahead = F.when(F.col("buy"), F.datediff("first_buy", "on"))
    near = dated.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if("buy").alias("n_buys"), F.datediff(F.max("on"), F.min("on")).alias("span"), *(F.count_if(ahead.between(0, n)).alias(f"within_{n}") for n in windows), F.min(F.when(ahead >= 0, ahead)).alias("closest"))
    out = base.join(near, key, "left")
    chance = lambda n: F.when((F.col("n_buys") > 0) & (F.col("span") > 0), F.round(poisson_base_rate(F.col("n_buys").cast("double"), F.col("span").cast("double"), F.lit(float(n))), 4)).otherwise(0.0)
    is_open, short = F.col("open_qty") != 0, F.col("open_qty") < 0
    unit = F.when(is_open, F.when(short, F.col("open_entry") - F.col("current")).otherwise(F.col("current") - F.col("open_entry"))).otherwise(F.when(F.col("__oq") > 0, F.col("realised") / F.col("__oq")).when(F.col("realised") != 0, 0.0))
    note = (
        F.when(is_open & F.col("current").isNull(), F.when(short, "OPEN short (unrealized); market price unavailable").otherwise("OPEN (unrealized); market price unavailable"))
        .when(is_open, F.when(short, "open short, unrealized").otherwise("open, unrealized")).when((F.col("realised") != 0) | (F.col("__oq") > 0), "CLOSED, realized").otherwise("flat / no position")
    )
    hit = F.coalesce(F.col(f"within_{match_days}") > 0, F.lit(False)) if match_days in windows else F.coalesce(F.col("closest") <= match_days, F.lit(False))
    return out.select(
        key, "fills", F.when(is_open, F.col("open_qty")).otherwise(F.coalesce("__oq", F.lit(0.0))).alias("qty"), F.when(is_open, F.col("open_entry")).otherwise(F.coalesce(F.col("__oc") / F.col("__oq"), F.lit(0.0))).alias("entry"),
        F.when(is_open, F.col("current")).otherwise(F.col("__cc") / F.col("__cq")).alias("current"), unit.alias("pnl_unit"), F.when(is_open, unit * F.abs("open_qty")).otherwise(F.when((F.col("realised") != 0) | (F.col("__oq") > 0), F.col("realised"))).alias("pnl"), note.alias("note"),
        "realised", "over_closes", F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("n_buys", F.lit(0)).alias("n_buys"), F.coalesce("span", F.lit(0)).alias("span_days"),
        *(F.coalesce(f"within_{n}", F.lit(0)).alias(f"within_{n}") for n in windows), *(chance(n).alias(f"chance_{n}") for n in windows), "closest", hit.alias("proxy_hit"),
    )
