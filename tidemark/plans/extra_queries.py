"""Queries of the remaining small rules: JSON fields, first reasons, top lists, dated estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import prices as P
from ..operators.consensus import resolver_dimension
from ..operators.portfolio import cap_group_weights, discount_alerts, gate_closed_events
from ..operators.stats import partial_pooling
from ..sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
D, O, X = "fx_disclosures", "fx_outcomes", "fx_text"


def _query(name: str, sql: str, *views: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


@_query("n19_snapshot_json", f"SELECT doc_id, source_row_id, part_key, supp_key, CASE WHEN part_key % 4 = 0 THEN NULL WHEN part_key % 4 <> 1 THEN quantity::DOUBLE END AS shares, CASE WHEN part_key % 4 = 0 THEN 'not_an_object' WHEN part_key % 4 = 1 THEN 'shares_negative' END AS reason FROM {D}", D)
def _(d):
    made = F.when(F.col("part_key") % 4 == 0, "n/a").otherwise(S.snapshot_to_json(F.when(F.col("part_key") % 4 == 1, -F.col("quantity") - 1).otherwise(F.col("quantity")).cast("double"), F.col("amount_midpoint"), F.col("disclosure_date")))
    got = S.snapshot_from_json(made)
    return d.select("doc_id", "source_row_id", "part_key", "supp_key", got["shares"].alias("shares"), got["reason"].alias("reason"))


QUERIES["n20_json_fields"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.json_field(F.col("props"), "$.k").cast("long").alias("k"), S.json_field(F.col("props"), "$.none").alias("other"))
ORACLES["n20_json_fields"] = "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS other FROM events"


@_query("n23_return_columns", "SELECT row_key, ((row_key % 50 + 60) * 0.999 / ((row_key % 40 + 50) * 1.001) - 1) * 100 AS ret, ((row_key % 30 + 60) * 0.999 / ((row_key % 20 + 50) * 1.001) - 1) * 100 AS bench FROM (SELECT row_key::DOUBLE AS row_key FROM fx_text)", X)
def _(x):
    k = F.col("row_key").cast("double")
    r = S.return_columns(k % 40 + 50, k % 50 + 60, k % 20 + 50, k % 30 + 60)
    return x.select(k.alias("row_key"), r["ret"].alias("ret"), r["bench"].alias("bench"))


@_query("n24_peak_potential", f"SELECT tx_id, CASE WHEN treated = 1 THEN (120 / (80 + score) - 1) * 100 END AS buy, CASE WHEN treated = 1 THEN (1 - 60 / (80 + score)) * 100 END AS sell FROM {O}", O)
def _(o):
    done, entry = F.col("treated") == 1, 80 + F.col("score")
    return o.select("tx_id", S.peak_potential(F.lit("Purchase"), entry, F.lit(120.0), F.lit(60.0), done).alias("buy"), S.peak_potential(F.lit("Sale"), entry, F.lit(120.0), F.lit(60.0), done).alias("sell"))


@_query("n31_row_rejection_reason", f"SELECT doc_id, source_row_id, part_key, supp_key, CASE WHEN part_key % 17 = 0 THEN 'asset' WHEN line_number < 2 THEN 'notification' WHEN transaction_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'out_of_window' END AS reason FROM {D}", D)
def _(d):
    asset = F.when(F.col("part_key") % 17 == 0, " ").otherwise(F.col("asset_description"))
    reason = S.row_rejection_reason(asset, F.col("transaction_type"), F.col("transaction_date"), F.date_add("transaction_date", (F.col("line_number") - 2).cast("int")), F.col("amount_midpoint"), "1996-01-01", "2000-12-31")
    return d.select("doc_id", "source_row_id", "part_key", "supp_key", reason.alias("reason"))


@_query("n35_explode_horizons", f"SELECT tx_id, unnest([30, 90, 180]) AS horizon FROM {O}", O)
def _(o):
    return P.explode_horizons(o.select("tx_id"), (30, 90, 180))


@_query("n36_expand_rename_aliases", "WITH t AS (SELECT DISTINCT CASE row_key % 4 WHEN 0 THEN 'FB' WHEN 1 THEN 'SQ' WHEN 2 THEN 'AAPL' ELSE 'BK' END AS raw FROM fx_text) SELECT raw, unnest(CASE raw WHEN 'FB' THEN ['FB', 'META'] WHEN 'SQ' THEN ['SQ', 'XYZ'] WHEN 'BK' THEN ['BK', 'BNY'] ELSE [raw] END) AS symbol FROM t", X)
def _(x):
    raw = F.element_at(F.array(*(F.lit(s) for s in ("FB", "SQ", "AAPL", "BK"))), (F.col("row_key") % 4 + 1).cast("int"))
    renames = resolver_dimension(x.sparkSession).where("rule = 'rename'").select("raw", "mapped")
    both = F.array_compact(F.array_distinct(F.array("raw", "mapped")))
    return x.select(raw.alias("raw")).distinct().join(F.broadcast(renames), "raw", "left").select("raw", F.explode(both).alias("symbol"))


@_query("f07_valid_price", "SELECT ticker, date, close FROM fx_prices WHERE close > 0 AND isfinite(close)", "fx_prices")
def _(p):
    return p.where(P.valid_price(F.col("close")))


@_query("f08_option_evidence", f"SELECT doc_id, source_row_id, part_key, supp_key, contains(lower(asset_description), '[op]') AS is_option FROM {D}", D)
def _(d):
    return d.select("doc_id", "source_row_id", "part_key", "supp_key", S.option_evidence(F.col("asset_description")).alias("is_option"))


@_query("f13_cash_or_fund", "SELECT row_key, coalesce(upper(trim(ticker_text)) = 'FUND', false) AS is_cash FROM fx_text", X)
def _(x):
    return x.select("row_key", S.cash_or_fund(F.col("ticker_text")).alias("is_cash"))


@_query("f14_discount_alerts", f"SELECT tx_id, alpha AS discount, score * 1000 AS cost FROM {O} WHERE alpha <= -5 AND score * 1000 >= 4000", O)
def _(o):
    return discount_alerts(o.select("tx_id", F.col("alpha").alias("discount"), (F.col("score") * 1000).alias("cost")), 5.0, 4000.0)


@_query("f16_rule_reference", f"SELECT tx_id, CASE WHEN treated = 0 AND score > 2 AND as_of BETWEEN DATE '1998-04-01' AND DATE '1998-06-01' THEN score END AS reference, CASE WHEN treated = 1 THEN 'corroboration_only' WHEN score <= 2 THEN 'no_reference' WHEN as_of NOT BETWEEN DATE '1998-04-01' AND DATE '1998-06-01' THEN 'too_old' END AS reason FROM {O}", O)
def _(o):
    r = S.rule_reference(F.when(F.col("score") > 2, F.col("score")), F.col("as_of"), F.lit("1998-06-01").cast("date"), F.lit(None).cast("string"), F.col("treated") == 1)
    return o.select("tx_id", r["reference"].alias("reference"), r["reason"].alias("reason"))


@_query("w13_cap_group_weights", f"SELECT tx_id, round((score + 1) / 8 * least(1.0::DOUBLE, 0.5::DOUBLE / sum((score + 1) / 8) OVER (PARTITION BY as_of, ticker)), 10) AS weight FROM {O}", O)
def _(o):
    return cap_group_weights(o.select("tx_id", "as_of", "ticker", ((F.col("score") + 1) / 8).alias("weight")), "weight", ["as_of", "ticker"], 0.5).select("tx_id", F.round("weight", 10).alias("weight"))


@_query("k02_top_signals", f"SELECT tx_id, member, alpha FROM {O} ORDER BY alpha DESC, tx_id LIMIT 20", O)
def _(o):
    return o.select("tx_id", "member", "alpha").orderBy(F.desc("alpha"), "tx_id").limit(20)


@_query("k03_ranked_members", f"SELECT member, count(*) AS n FROM {O} GROUP BY member ORDER BY n DESC, member LIMIT 10", O)
def _(o):
    return partial_pooling(o, "member", "alpha").select("member", "n").orderBy(F.desc("n"), "member").limit(10)


@_query("k07_recent_filings", f"SELECT doc_id, max(disclosure_date) AS disclosed FROM {D} WHERE source = 'form4' GROUP BY doc_id ORDER BY disclosed DESC, doc_id LIMIT 25", D)
def _(d):
    return d.where("source = 'form4'").groupBy("doc_id").agg(F.max("disclosure_date").alias("disclosed")).orderBy(F.desc("disclosed"), "doc_id").limit(25)


@_query("j14_latest_estimate_asof", f"SELECT ticker, arg_max(score, (as_of, tx_id)) AS estimate, max(as_of) AS dated FROM {O} WHERE as_of <= DATE '1998-06-01' GROUP BY ticker", O)
def _(o):
    return o.where("as_of <= DATE '1998-06-01'").groupBy("ticker").agg(F.max_by("score", F.struct("as_of", "tx_id")).alias("estimate"), F.max("as_of").alias("dated"))


@_query("j29_gate_closed_events", f"WITH p AS (SELECT ticker, member, min(as_of) AS first_lot FROM {O} WHERE treated = 1 GROUP BY 1, 2) SELECT tx_id, CASE WHEN first_lot IS NULL THEN 'no_open_position' WHEN as_of < first_lot THEN 'before_first_lot' END AS blocked, CASE WHEN as_of >= first_lot THEN score END AS entry_ref FROM {O} LEFT JOIN p USING (ticker, member)", O)
def _(o):
    events = o.select("tx_id", "ticker", "member", F.col("as_of").alias("event_date"), F.col("score").alias("entry_ref"))
    held = o.where("treated = 1").select("ticker", "member", F.col("as_of").alias("first_lot"))
    return gate_closed_events(events, held).select("tx_id", "blocked", "entry_ref")
