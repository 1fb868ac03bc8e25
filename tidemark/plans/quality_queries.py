"""Queries of the admission and audit operators over the fixture views, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices as P
from ..operators import quality as Q
from ..sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
D, R = "fx_disclosures", "fx_runs"
_RS = "doc_id, source, ingestion_generation"


def _query(name: str, sql: str, *views: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


def _day(text: str):
    return F.lit(text).cast("date")


_ACC = f"""live AS (SELECT {_RS}, count(*) AS live, count(*) FILTER (WHERE transaction_date > disclosure_date) AS bad FROM {D} GROUP BY {_RS}),
acc AS (SELECT r.* FROM {R} r JOIN live USING ({_RS}) WHERE stated_count = live AND ((status = 'success' AND bad = 0)))"""


@_query("j02_accepted_rowsets", f"WITH {_ACC} SELECT {_RS}, status, stated_count FROM acc", D, R)
def _(d, r):
    return Q.accepted_rowsets(d, r).select(*Q.ROWSET, "status", "stated_count")


@_query("j03_latest_accepted_docs", f"WITH {_ACC} SELECT archive_year::INT AS archive_year, doc_id, source, parsed_at FROM (SELECT *, row_number() OVER (PARTITION BY archive_year, doc_id ORDER BY parsed_at DESC, source, ingestion_generation) AS k FROM acc WHERE promoted) WHERE k = 1", D, R)
def _(d, r):
    return Q.latest_accepted_docs(Q.accepted_rowsets(d, r)).select(F.col("archive_year").cast("int").alias("archive_year"), "doc_id", "source", "parsed_at")


_CANON = f"""WITH {_ACC}, seen AS (SELECT * FROM {D} WHERE transaction_date <= disclosure_date AND (source IN ('senate_efd', 'form4', '13f') OR ({_RS}) IN (SELECT {_RS} FROM acc WHERE promoted))),
canon AS (SELECT * FROM seen s WHERE NOT (source = 'gemini_ocr' AND EXISTS (SELECT 1 FROM seen h WHERE h.source = 'house_pdf' AND h.doc_id = s.doc_id AND h.ingestion_generation IS NOT DISTINCT FROM s.ingestion_generation)))"""


@_query("j01_canonical_transactions", f"{_CANON} SELECT doc_id, source, source_row_id, part_key, supp_key FROM canon", D, R)
def _(d, r):
    return Q.canonical_transactions(d, r).select("doc_id", "source", "source_row_id", "part_key", "supp_key")


@_query("j04_prefer_producer", f"SELECT doc_id, source, source_row_id, part_key FROM {D} s WHERE NOT (source = 'gemini_ocr' AND EXISTS (SELECT 1 FROM {D} h WHERE h.source = 'house_pdf' AND h.doc_id = s.doc_id AND h.ingestion_generation = s.ingestion_generation))", D)
def _(d):
    return Q.prefer_producer(d).select("doc_id", "source", "source_row_id", "part_key")


@_query("j06_j07_as_of_acceptance", f"SELECT {_RS}, parsed_at, watermark FROM {R} JOIN (SELECT {_RS}, max(disclosure_date + 1) AS watermark FROM {D} GROUP BY {_RS}) USING ({_RS}) WHERE parsed_at <= DATE '1998-06-01' AND parsed_at >= watermark", D, R)
def _(d, r):
    return Q.as_of_acceptance(r, d.withColumn("created_at", F.date_add("disclosure_date", 1)), _day("1998-06-01")).select(*Q.ROWSET, "parsed_at", "watermark")


@_query("g17_unresolved_documents", f"WITH {_ACC} SELECT DISTINCT doc_id FROM {D} EXCEPT SELECT doc_id FROM acc", D, R)
def _(d, r):
    return Q.unresolved_documents(d, d, r)


@_query("g34_run_row_mismatches", f"SELECT {_RS}, status, stated_count, live, concat_ws(',', CASE WHEN stated_count <> live THEN 'count' END, CASE WHEN status <> 'success' THEN 'status' END) AS reasons FROM {R} JOIN (SELECT {_RS}, count(*) AS live FROM {D} GROUP BY {_RS}) USING ({_RS}) WHERE stated_count <> live OR status <> 'success'", D, R)
def _(d, r):
    return Q.run_row_mismatches(d, r)


@_query("g14_g16_report_outcomes", f"SELECT source, ingestion_generation, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'invalid') AS invalid, sum(stated_count)::BIGINT AS stated FROM {R} GROUP BY 1, 2", R)
def _(r):
    return Q.report_outcomes(r)


@_query("g18_work_selection", f"WITH l AS (SELECT doc_id, parsed_at, status, row_number() OVER (PARTITION BY doc_id ORDER BY parsed_at DESC, source, ingestion_generation) AS k FROM {R} WHERE source <> 'gemini_ocr'), f AS (SELECT doc_id, sum(stated_count)::BIGINT AS n, max(parsed_at) AS at_ FROM {R} WHERE source = 'gemini_ocr' GROUP BY 1) SELECT l.doc_id, l.parsed_at, coalesce(n, 0) AS fallback_rows, coalesce(at_ < l.parsed_at, true) AS stale FROM l LEFT JOIN f USING (doc_id) WHERE k = 1 AND status = 'failed'", R)
def _(r):
    return Q.work_selection(r)


@_query("g36_canary_counts", f"WITH p AS (SELECT DISTINCT doc_id, 2::BIGINT AS pinned FROM {D} WHERE order_key % 50 = 0) SELECT doc_id, pinned, count(d.ticker) AS n FROM p LEFT JOIN {D} d USING (doc_id) GROUP BY 1, 2 HAVING count(d.ticker) <> pinned", D)
def _(d):
    return Q.canary_counts(d, d.where("order_key % 50 = 0").select("doc_id", F.lit(2).cast("long").alias("pinned")).distinct())


_DATES = f"SELECT 'trade_out_of_domain' AS rule, doc_id, source_row_id, part_key, supp_key FROM {D} WHERE transaction_date NOT BETWEEN DATE '1995-06-01' AND DATE '2001-06-30' UNION ALL SELECT 'trade_after_disclosure', doc_id, source_row_id, part_key, supp_key FROM {D} WHERE transaction_date > disclosure_date"


@_query("g37_date_domain_violations", _DATES, D)
def _(d):
    return Q.date_domain_violations(d, "1995-06-01", "2001-06-30")


@_query(
    "c04_audit_report",
    f"""WITH v AS (SELECT rule, count(*) AS n FROM ({_DATES}) GROUP BY 1 UNION ALL SELECT 'run_count', count(*) FILTER (WHERE stated_count <> live) FROM {R} JOIN (SELECT {_RS}, count(*) AS live FROM {D} GROUP BY {_RS}) USING ({_RS}) UNION ALL SELECT 'run_status', count(*) FROM {R} WHERE status <> 'success')
SELECT rule, coalesce(n, 0) AS violations, n IS NULL AS passed FROM (SELECT unnest(['trade_out_of_domain', 'missing_date', 'trade_after_disclosure', 'run_count', 'run_status']) AS rule) LEFT JOIN v USING (rule)""",
    D, R,
)
def _(d, r):
    return Q.audit_report(d, r, "1995-06-01", "2001-06-30")


@_query("f09_oversized_report_quarantine", f"SELECT doc_id, source, source_row_id, part_key, CASE WHEN count(*) OVER (PARTITION BY doc_id, source) > 3 THEN 'oversized_report' END AS quarantine FROM {D}", D)
def _(d):
    return Q.oversized_report_quarantine(d, 3).select("doc_id", "source", "source_row_id", "part_key", "quarantine")


@_query("f10_no_future_rows", f"SELECT doc_id, source_row_id, part_key FROM {D} WHERE greatest(transaction_date, disclosure_date) > DATE '2001-07-15'", D)
def _(d):
    return Q.no_future_rows(d, _day("2001-07-15")).select("doc_id", "source_row_id", "part_key")


@_query("j24_inventory_coverage", f"WITH e AS (SELECT DISTINCT extract(year FROM disclosure_date)::INT AS year, doc_id FROM {D} WHERE order_key % 3 <> 0), p AS (SELECT DISTINCT extract(year FROM disclosure_date)::INT AS year, doc_id FROM {D} WHERE order_key % 4 <> 0) SELECT year, count(*) FILTER (WHERE e.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS covered, count(*) FILTER (WHERE p.doc_id IS NULL) AS missing, count(*) FILTER (WHERE e.doc_id IS NULL) AS orphan FROM e FULL JOIN p USING (year, doc_id) GROUP BY year".replace("e.doc_id IS NOT NULL AND p.doc_id IS NOT NULL", "e.doc_id = p.doc_id"), D)
def _(d):
    y = d.withColumn("year", F.year("disclosure_date"))
    return Q.inventory_coverage(y.where("order_key % 3 <> 0"), y.where("order_key % 4 <> 0"))


@_query("j26_join_outcomes", f"WITH a AS (SELECT ticker, disclosure_date, count(*) AS a FROM {D} WHERE part_key % 2 = 0 GROUP BY 1, 2), b AS (SELECT ticker, disclosure_date, count(*) AS b FROM {D} WHERE supp_key % 2 = 0 GROUP BY 1, 2) SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only, count(*) FILTER (WHERE a > 1 OR b > 1) AS repeated FROM a FULL JOIN b USING (ticker, disclosure_date)", D)
def _(d):
    return Q.join_outcomes(d.where("part_key % 2 = 0"), d.where("supp_key % 2 = 0"), ["ticker", "disclosure_date"])


_ALTER = "CASE WHEN part_key % 13 = 0 THEN 'ZZ' ELSE ticker END"


@_query("j33_compare_readings", f"WITH a AS (SELECT doc_id, ticker, transaction_type, count(*) AS a FROM {D} GROUP BY ALL), b AS (SELECT doc_id, {_ALTER} AS ticker, transaction_type, count(*) AS b FROM {D} GROUP BY ALL), x AS (SELECT doc_id, coalesce(a, 0) - coalesce(b, 0) AS d FROM a FULL JOIN b USING (doc_id, ticker, transaction_type)) SELECT doc_id, sum(greatest(d, 0))::BIGINT AS only_in_a, sum(greatest(-d, 0))::BIGINT AS only_in_b, sum(abs(d)) = 0 AS equal FROM x GROUP BY doc_id", D)
def _(d):
    return Q.compare_readings(d, d.withColumn("ticker", F.when(F.col("part_key") % 13 == 0, "ZZ").otherwise(F.col("ticker"))), ["ticker", "transaction_type"])


@_query("j34_merge_extractions", f"SELECT doc_id, ticker, transaction_type, max(n) AS copies, count(*) AS extractors, max(n) <> min(n) AS disagree FROM (SELECT doc_id, source, ticker, transaction_type, count(*) AS n FROM {D} GROUP BY ALL) GROUP BY 1, 2, 3", D)
def _(d):
    return Q.merge_extractions(d, ["ticker", "transaction_type"])


@_query("g55_extraction_quality", f"SELECT doc_id, source, count(*) AS rows, avg((amount_midpoint > 0 AND transaction_date <= disclosure_date)::INT) AS quality FROM {D} GROUP BY 1, 2", D)
def _(d):
    return Q.extraction_quality(d)


@_query("j23_reconcile_exact_keys", f"WITH w AS (SELECT *, count(*) OVER (PARTITION BY member, transaction_date) AS m FROM {D} WHERE part_key % 2 = 0), o AS (SELECT member, transaction_date, count(*) AS c, min(ticker) AS v FROM {D} WHERE part_key % 2 = 1 GROUP BY 1, 2) SELECT w.doc_id, w.source_row_id, w.part_key, w.supp_key, CASE WHEN c = 1 AND m = 1 THEN v END AS proposal, CASE WHEN c IS NULL THEN 'no_match' WHEN m > 1 THEN 'repeated_here' WHEN c > 1 THEN 'repeated_there' END AS reason FROM w LEFT JOIN o USING (member, transaction_date)", D)
def _(d):
    return Q.reconcile_exact_keys(d.where("part_key % 2 = 0"), d.where("part_key % 2 = 1"), ["member", "transaction_date"], "ticker").select("doc_id", "source_row_id", "part_key", "supp_key", "proposal", "reason")


@_query("j16_preserve_resolved_fields", f"WITH e AS (SELECT doc_id, source_row_id, count(DISTINCT ticker) AS c, min(ticker) AS v FROM {D} WHERE part_key % 3 <> 0 GROUP BY 1, 2) SELECT doc_id, source_row_id, part_key, supp_key, coalesce(CASE WHEN part_key % 2 = 0 THEN ticker END, CASE WHEN c = 1 THEN v END) AS ticker FROM {D} LEFT JOIN e USING (doc_id, source_row_id)", D)
def _(d):
    new = d.withColumn("ticker", F.when(F.col("part_key") % 2 == 0, F.col("ticker")))
    return Q.preserve_resolved_fields(new, d.where("part_key % 3 <> 0"), ["doc_id", "source_row_id"], "ticker").select("doc_id", "source_row_id", "part_key", "supp_key", "ticker")


@_query("g49_compare_coverage", "WITH a AS (SELECT ticker, count(*) AS before FROM fx_prices WHERE date < DATE '1999-01-04' GROUP BY 1), b AS (SELECT ticker, count(*) AS after FROM fx_prices WHERE date >= DATE '1997-01-01' GROUP BY 1) SELECT ticker, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (ticker) WHERE before IS DISTINCT FROM after", "fx_prices")
def _(p):
    n = lambda c: p.where(c).groupBy("ticker").agg(F.count(F.lit(1)).alias("days"))
    return Q.compare_coverage(n("date < DATE '1999-01-04'"), n("date >= DATE '1997-01-01'"))


@_query("j30_served_prices", "WITH v AS (SELECT *, CASE WHEN extract(year FROM date) % 2 = 0 THEN 'g1' ELSE 'g2' END AS generation FROM fx_prices) SELECT ticker, generation, date, close, 'adjusted' AS basis FROM v WHERE generation = CASE WHEN ticker < 'TK' THEN 'g1' ELSE 'g2' END AND ticker <> 'SPY'", "fx_prices")
def _(p):
    values = p.withColumn("generation", F.when(F.year("date") % 2 == 0, "g1").otherwise("g2"))
    state = p.select("ticker").distinct().select("ticker", F.when(F.col("ticker") < "TK", "g1").otherwise("g2").alias("served"), (F.col("ticker") != "SPY").alias("comparable"), F.lit("adjusted").alias("basis"))
    return Q.served_prices(values, state)


_GENS = "v AS (SELECT *, CASE WHEN extract(year FROM date) % 2 = 0 THEN 'g1' ELSE 'g2' END AS generation FROM fx_prices)"


@_query(
    "j32_decision_quote",
    f"""WITH {_GENS}, served AS (SELECT ticker, date, max(close) AS close FROM v WHERE generation = CASE WHEN ticker < 'TK' THEN 'g1' ELSE 'g2' END AND ticker NOT LIKE 'TE%' AND close > 0 GROUP BY 1, 2),
k AS (SELECT DISTINCT ticker, decision_date AS day FROM fx_decisions), a AS (SELECT k.*, p.date AS d1, p.close AS q1 FROM k ASOF LEFT JOIN (SELECT ticker, date, max(close) AS close FROM fx_prices WHERE close > 0 AND extract(day FROM date) < 20 AND (ticker > 'TC' OR date > DATE '1997-01-01') GROUP BY 1, 2) p ON k.ticker = p.ticker AND k.day >= p.date),
b AS (SELECT a.*, p.date AS d2, p.close AS q2 FROM a ASOF LEFT JOIN served p ON a.ticker = p.ticker AND a.day >= p.date),
c AS (SELECT *, coalesce(date_diff('day', d1, day) > 5 AND d2 > d1, false) AS from_newer FROM b)
SELECT ticker, day, CASE WHEN from_newer THEN d2 ELSE d1 END AS quote_date, CASE WHEN from_newer THEN q2 ELSE q1 END AS quote, from_newer FROM c""",
    "fx_decisions", "fx_prices",
)
def _(k, p):
    keys, one = k.select("ticker", F.col("decision_date").alias("day")).distinct(), p.where("close > 0").groupBy("ticker", "date").agg(F.max("close").alias("close"))
    state = p.select("ticker").distinct().select("ticker", F.when(F.col("ticker") < "TK", "g1").otherwise("g2").alias("served"), (~F.col("ticker").like("TE%")).alias("comparable"), F.lit("adjusted").alias("basis"))
    served = Q.served_prices(one.withColumn("generation", F.when(F.year("date") % 2 == 0, "g1").otherwise("g2")), state)
    return Q.decision_quote(P.price_asof(keys, one.where("day(date) < 20 AND (ticker > 'TC' OR date > DATE '1997-01-01')")), P.price_asof(keys, served))


@_query("s17_unpromoted_rows", f"WITH {_ACC} SELECT doc_id, source_row_id, part_key, supp_key FROM {D} WHERE source NOT IN ('senate_efd', 'form4', '13f') AND doc_id NOT IN (SELECT doc_id FROM acc WHERE promoted)", D, R)
def _(d, r):
    return Q.unpromoted_rows(d, r).select("doc_id", "source_row_id", "part_key", "supp_key")


@_query("w14_triage_priority", f"""WITH p AS (SELECT member, count(DISTINCT doc_id) AS n FROM {D} WHERE chamber = 'house' AND source = 'house_pdf' GROUP BY member), q AS (SELECT doc_id, min(disclosure_date) AS filing_date, min(member) AS member FROM {D} GROUP BY doc_id)
SELECT doc_id, recency_rank, prominence, prominence * recency_rank AS priority FROM (SELECT doc_id, dense_rank() OVER (ORDER BY filing_date)::INT AS recency_rank, greatest(coalesce(n, 0), 1) AS prominence FROM q LEFT JOIN p USING (member))""", D)
def _(d):
    active = d.where("chamber = 'house' AND source = 'house_pdf'").groupBy("member").agg(F.count_distinct("doc_id").alias("prominence"))
    docs = d.groupBy("doc_id").agg(F.min("disclosure_date").alias("filing_date"), F.min("member").alias("member")).join(active, "member", "left")
    return Q.triage_priority(docs).select("doc_id", "recency_rank", "prominence", "priority")


@_query("g19_scope_status", f"""WITH e AS (SELECT DISTINCT ingestion_generation, doc_id FROM {D}), s AS (SELECT ingestion_generation, doc_id, min(CASE status WHEN 'success' THEN 0 WHEN 'invalid' THEN 1 ELSE 2 END) AS st FROM {R} WHERE archive_year <> 1997 GROUP BY 1, 2)
SELECT ingestion_generation, count(*) AS expected, count(*) FILTER (WHERE st = 0) AS done, count(*) FILTER (WHERE st = 1) AS rejected, count(*) FILTER (WHERE st IS NULL OR st = 2) AS open FROM e LEFT JOIN s USING (ingestion_generation, doc_id) GROUP BY 1""", D, R)
def _(d, r):
    return Q.scope_status(d, r.where("archive_year <> 1997"))


@_query("g39_completeness_scope", f"""WITH i AS (SELECT DISTINCT ingestion_generation AS g, doc_id FROM {D} WHERE order_key % 97 <> 0), r AS (SELECT DISTINCT ingestion_generation AS g, doc_id FROM {R} WHERE status <> 'failed'), w AS (SELECT DISTINCT ingestion_generation AS g, doc_id FROM {D}),
a AS (SELECT g, doc_id, max(i) AS i, max(r) AS r, max(w) AS w FROM (SELECT g, doc_id, 1 AS i, NULL AS r, NULL AS w FROM i UNION ALL SELECT g, doc_id, NULL, 1, NULL FROM r UNION ALL SELECT g, doc_id, NULL, NULL, 1 FROM w) GROUP BY 1, 2)
SELECT g AS ingestion_generation, count(i) AS indexed, count(r) AS parsed, count(w) AS stored, count(*) FILTER (WHERE i IS NULL) AS unexpected, count(i) = count(r) AND count(i) = count(w) AND count(*) = count(i) AS complete FROM a GROUP BY g""", D, R)
def _(d, r):
    return Q.completeness_scope(d.where("order_key % 97 <> 0"), r.where("status <> 'failed'"), d, "ingestion_generation")


_ORIGIN = """CASE part_key % 7 WHEN 0 THEN 'official' WHEN 1 THEN 'asset_description' WHEN 2 THEN 'unverified' WHEN 3 THEN 'non_equity' WHEN 4 THEN 'missing' WHEN 5 THEN 'invalid' ELSE 'guess' END AS ticker_origin,
 CASE supp_key % 4 WHEN 0 THEN ticker WHEN 1 THEN 'NOTE' WHEN 2 THEN NULL ELSE 'lower' END AS ticker, CASE order_key % 4 WHEN 0 THEN NULL WHEN 1 THEN ticker WHEN 2 THEN 'BOND' ELSE '12' END AS ticker_candidate, CASE line_number % 5 WHEN 0 THEN NULL WHEN 1 THEN '--' WHEN 2 THEN lower(ticker) WHEN 3 THEN ' ' ELSE 'x9' END AS raw_ticker"""


@_query(
    "n34_ticker_origin_violations",
    f"""WITH x AS (SELECT doc_id, source_row_id, part_key, supp_key, {_ORIGIN} FROM {D}), y AS (SELECT *, nullif(upper(trim(raw_ticker)), '') AS r, coalesce(regexp_full_match(ticker, '[A-Z]{{1,5}}([.-][A-Z]{{1,2}})?'), false) AS tv, coalesce(regexp_full_match(ticker_candidate, '[A-Z]{{1,5}}([.-][A-Z]{{1,2}})?'), false) AS cv, coalesce(ticker IN ('COUPON', 'BOND', 'BONDS', 'NOTE', 'NOTES', 'STOCK', 'TICKER'), false) AS tr, coalesce(ticker_candidate IN ('COUPON', 'BOND', 'BONDS', 'NOTE', 'NOTES', 'STOCK', 'TICKER'), false) AS cr FROM x),
z AS (SELECT *, r IS NULL OR r = '--' AS blank, coalesce(regexp_full_match(r, '[A-Z]{{1,5}}([.-][A-Z]{{1,2}})?'), false) AS rv FROM y)
SELECT doc_id, source_row_id, part_key, supp_key, CASE ticker_origin WHEN 'guess' THEN 'unknown_origin' ELSE ticker_origin || '_inconsistent' END AS rule FROM z
WHERE NOT CASE ticker_origin WHEN 'official' THEN tv AND ticker_candidate IS NULL AND coalesce(r = ticker, false) WHEN 'asset_description' THEN tv AND NOT tr AND ticker_candidate IS NULL AND blank WHEN 'unverified' THEN ticker IS NULL AND cv AND NOT cr AND blank
 WHEN 'non_equity' THEN ticker IS NULL AND ticker_candidate IS NULL AND blank WHEN 'missing' THEN ticker IS NULL AND ticker_candidate IS NULL AND blank WHEN 'invalid' THEN ticker IS NULL AND NOT (cv AND NOT cr) AND CASE WHEN ticker_candidate IS NULL THEN NOT blank AND NOT rv ELSE blank END ELSE false END""",
    D,
)
def _(d):
    return Q.ticker_origin_violations(d.select("doc_id", "source_row_id", "part_key", "supp_key", *_origin_columns())).select("doc_id", "source_row_id", "part_key", "supp_key", "rule")


def _origin_columns():
    pick = lambda c, n, xs: F.element_at(F.array(*xs), (F.col(c) % n + 1).cast("int"))
    none, t = F.lit(None).cast("string"), F.col("ticker")
    return [
        pick("part_key", 7, [F.lit(x) for x in ("official", "asset_description", "unverified", "non_equity", "missing", "invalid", "guess")]).alias("ticker_origin"),
        pick("supp_key", 4, [t, F.lit("NOTE"), none, F.lit("lower")]).alias("ticker"), pick("order_key", 4, [none, t, F.lit("BOND"), F.lit("12")]).alias("ticker_candidate"),
        pick("line_number", 5, [none, F.lit("--"), F.lower(t), F.lit(" "), F.lit("x9")]).alias("raw_ticker"),
    ]


# Reports of a replacement, each with faults by its number, and rows bound to reports; the texts run in both engines.
_ID = "concat(substr(md5(doc_id), 1, 8), '-', substr(md5(doc_id), 9, 4), '-', substr(md5(doc_id), 13, 4), '-', substr(md5(doc_id), 17, 4), '-', substr(md5(doc_id), 21, 12))"
_HASH = "concat(md5(doc_id), md5(concat(doc_id, 'x')))"
_FILED = f"SELECT doc_id, {_ID} AS id, {_HASH} AS h, CAST(max(order_key) AS bigint) AS k, CAST(count(*) AS double) AS n, min(member) AS member, min(disclosure_date) AS filed FROM {D} GROUP BY doc_id"
_SUBMITTED = """SELECT CASE WHEN k % 13 = 0 THEN 'g9' ELSE 'g1' END AS ingestion_generation, CASE WHEN k % 11 = 0 THEN 'house' ELSE 'senate' END AS chamber, CASE WHEN k % 101 = 0 THEN ' ' WHEN k % 103 = 0 THEN NULL ELSE id END AS source_record_id, o AS outcome,
 CASE WHEN k % 29 = 0 THEN CAST(1.5 AS double) WHEN o IN ('no_txs', 'paper_only') THEN CASE WHEN k % 19 = 0 THEN CAST(2 AS double) ELSE CAST(0 AS double) END ELSE n + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END END AS raw, CASE WHEN o IN ('no_txs', 'paper_only') THEN CAST(0 AS double) WHEN o = 'failed' THEN n - 1 ELSE n END AS accepted,
 CASE WHEN k % 23 = 0 THEN CAST(-1 AS double) WHEN o = 'failed' THEN CAST(1 AS double) ELSE CAST(0 AS double) END AS rejected, CASE WHEN k % 61 = 0 THEN upper(h) ELSE h END AS artifact_sha256, CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN concat(substr(h, 2, 63), 'a') ELSE h END AS landing_sha256,
 CASE WHEN o = 'paper_only' AND k % 41 <> 0 OR o <> 'paper_only' AND k % 43 = 0 THEN h END AS paper_artifact_sha256, CASE WHEN k % 47 = 0 THEN 'http://efdsearch.senate.gov/media/x' WHEN k % 53 = 0 THEN 'https://efdsearch.senate.gov/search/view/paper/1?q' WHEN o = 'paper_only' OR k % 59 = 0 THEN 'https://efdsearch.senate.gov/media/x' END AS paper_artifact_url,
 CASE WHEN k % 67 = 0 THEN '' ELSE concat('/search/view/ptr/', id, '/') END AS report_path, CASE WHEN k % 71 = 0 THEN concat(member, ' ') ELSE member END AS member, CASE WHEN k % 73 = 0 THEN 'soon' ELSE CAST(filed AS varchar(10)) END AS filed_text
FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 'no_txs' WHEN k % 7 = 1 THEN 'paper_only' WHEN k % 35 = 2 THEN 'failed' WHEN k % 35 = 3 THEN 'lost' ELSE 'parsed' END AS o FROM fd) x, (SELECT 1 AS i UNION ALL SELECT 2) t WHERE i = 1 OR k % 79 = 0"""
_URL = "^https://efdsearch[.]senate[.]gov(/media/|/search/view/paper/|/search/view/paper-filing/)[^?#]*$"


@_query(
    "g15_report_violations",
    f"""WITH fd AS ({_FILED}), r AS MATERIALIZED ({_SUBMITTED}), z AS (SELECT *, count(*) OVER (PARTITION BY source_record_id) AS again, coalesce(artifact_sha256 = landing_sha256, false) AS same, raw = 0 AND accepted = 0 AND rejected = 0 AS none FROM r)
SELECT source_record_id AS report_id, unnest(list_filter([CASE WHEN source_record_id IS NULL THEN 'required' END, CASE WHEN ingestion_generation <> 'g1' THEN 'other_generation' END, CASE WHEN chamber <> 'senate' THEN 'other_chamber' END, CASE WHEN trim(coalesce(source_record_id, '')) = '' THEN 'blank_id' END, CASE WHEN source_record_id IS NOT NULL AND again > 1 THEN 'repeated_id' END,
 CASE WHEN raw % 1 <> 0 OR rejected < 0 THEN 'counts' END, CASE WHEN artifact_sha256 <> lower(artifact_sha256) THEN 'hash_form' END, CASE WHEN outcome = 'parsed' AND (accepted <= 0 OR rejected <> 0 OR raw <> accepted) THEN 'parsed_counts' END, CASE WHEN outcome = 'parsed' AND NOT same THEN 'parsed_hashes' END,
 CASE WHEN outcome = 'no_txs' AND chamber <> 'house' THEN 'no_txs_chamber' END, CASE WHEN outcome = 'no_txs' AND NOT none THEN 'no_txs_counts' END, CASE WHEN outcome = 'no_txs' AND NOT same THEN 'no_txs_hashes' END, CASE WHEN outcome = 'paper_only' AND chamber <> 'senate' THEN 'paper_chamber' END, CASE WHEN outcome = 'paper_only' AND NOT none THEN 'paper_counts' END,
 CASE WHEN outcome = 'paper_only' AND (NOT same OR paper_artifact_sha256 IS NULL) THEN 'paper_hashes' END, CASE WHEN outcome = 'paper_only' AND NOT coalesce(regexp_matches(paper_artifact_url, '{_URL}'), false) THEN 'paper_url' END, CASE WHEN outcome <> 'paper_only' AND (paper_artifact_url IS NOT NULL OR paper_artifact_sha256 IS NOT NULL) THEN 'paper_fields' END,
 CASE WHEN outcome IN ('no_txs', 'failed') AND raw <> accepted + rejected THEN 'count_equation' END, CASE WHEN outcome = 'lost' THEN 'unknown_outcome' END, CASE WHEN outcome = 'failed' THEN 'not_replaceable' END, CASE WHEN report_path = '' THEN 'report_path' END, CASE WHEN member <> trim(member) THEN 'member' END, CASE WHEN filed_text = 'soon' THEN 'filing_date' END], lambda x: x IS NOT NULL)) AS rule FROM z""",
    D,
)
def _(d):
    spark = d.sparkSession
    fd = spark.sql(_FILED.replace(D, "{d}"), d=d)
    return Q.report_violations(spark.sql(_SUBMITTED.replace("FROM fd", "FROM {fd}"), fd=fd), "g1", "senate")


_BOUND_ROWS = f"SELECT CASE WHEN order_key % 149 = 0 THEN NULL ELSE {_ID} END AS source_record_id, concat('/search/view/ptr/', {_ID}, CASE WHEN part_key % 79 = 0 THEN '' ELSE '/' END) AS source_report_path, CASE WHEN part_key % 83 = 0 THEN doc_id ELSE {_ID} END AS doc_id, CASE WHEN part_key % 89 = 0 THEN 'OTHER' ELSE member END AS member, CASE WHEN part_key % 97 = 0 THEN NULL WHEN part_key % 89 = 0 THEN 'OTHER' ELSE member END AS member_key, concat('senate:', CASE WHEN part_key % 89 = 0 THEN 'OTHER' ELSE member END) AS chamber_member_key, CASE WHEN part_key % 107 <> 0 THEN {_HASH} END AS artifact_sha256, disclosure_date AS official_filing_date, CASE WHEN part_key % 109 <> 0 THEN disclosure_date END AS available_date, disclosure_date, order_key AS k FROM {D}"
_HELD_REPORTS = "SELECT id AS source_record_id, CASE WHEN k % 67 = 0 THEN '/search' ELSE concat('/search/view/ptr/', id, '/') END AS report_path, member, h AS landing_sha256, CASE WHEN k % 127 <> 0 THEN filed END AS official_filing_date, CAST(n + CASE WHEN k % 131 = 0 THEN 1 ELSE 0 END AS bigint) AS accepted, CASE WHEN k % 137 = 0 THEN 'failed' ELSE 'parsed' END AS outcome FROM fd WHERE k % 139 <> 0"


@_query(
    "j35_report_binding_violations",
    f"""WITH fd AS ({_FILED}), r AS MATERIALIZED ({_HELD_REPORTS}), w AS MATERIALIZED ({_BOUND_ROWS}), m AS (SELECT w.*, r.source_record_id AS rid, report_path, r.member AS rm, landing_sha256, r.official_filing_date AS rd FROM w LEFT JOIN r ON r.source_record_id = w.source_record_id),
f AS (SELECT source_record_id AS report_id, bool_or(rid IS NULL) AS f0, bool_or(rid IS NOT NULL AND source_report_path <> report_path) AS f1, bool_or(rid IS NOT NULL AND member <> rm) AS f2, bool_or(rid IS NOT NULL AND (member_key IS DISTINCT FROM member OR chamber_member_key <> concat('senate:', member))) AS f3, bool_or(rid IS NOT NULL AND doc_id <> source_record_id) AS f4,
  bool_or(rid IS NOT NULL AND artifact_sha256 IS DISTINCT FROM landing_sha256) AS f5, bool_or(rid IS NOT NULL AND (rd IS NULL OR available_date IS NULL)) AS f6, bool_or(rid IS NOT NULL AND rd IS NOT NULL AND available_date IS NOT NULL AND disclosure_date <> rd) AS f7, count(*) AS stored FROM m GROUP BY 1),
b AS (SELECT coalesce(f.report_id, r.source_record_id) AS report_id, f.*, r.source_record_id AS rid, report_path, accepted, outcome FROM f FULL JOIN r ON r.source_record_id = f.report_id)
SELECT * FROM (SELECT report_id, concat_ws(',', CASE WHEN f0 THEN 'no_report' END, CASE WHEN f1 THEN 'path' END, CASE WHEN f2 THEN 'member' END, CASE WHEN f3 THEN 'member_keys' END, CASE WHEN f4 THEN 'doc_id' END, CASE WHEN f5 THEN 'hash' END, CASE WHEN f6 THEN 'dates' END, CASE WHEN f7 THEN 'date' END,
 CASE WHEN rid IS NOT NULL AND report_path <> concat('/search/view/ptr/', rid, '/') THEN 'report_path' END, CASE WHEN rid IS NOT NULL AND coalesce(stored, 0) <> accepted THEN 'count' END, CASE WHEN rid IS NOT NULL AND stored > 0 AND outcome <> 'parsed' THEN 'outcome' END) AS reasons FROM b) WHERE reasons <> ''""",
    D,
)
def _(d):
    spark = d.sparkSession
    held = spark.sql(_HELD_REPORTS.replace("FROM fd", "FROM {fd}"), fd=spark.sql(_FILED.replace(D, "{d}"), d=d))
    return Q.report_binding_violations(spark.sql(_BOUND_ROWS.replace(D, "{d}"), d=d), held, "senate_efd", "senate")


_ENTRY = f"SELECT doc_id, CASE part_key % 6 WHEN 0 THEN 'FAIL' WHEN 1 THEN NULL WHEN 2 THEN 'maybe' ELSE 'pass' END AS verdict, CASE supp_key % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'Cosmetic' END AS severity FROM {D}"


@_query("g32_audit_verdicts", f"""WITH e AS (SELECT doc_id, lower(verdict) AS v, lower(severity) AS s FROM ({_ENTRY})), p AS (SELECT doc_id, count(*) FILTER (WHERE v = 'fail') AS f, count(*) FILTER (WHERE v = 'pass') AS p, count(*) FILTER (WHERE v = 'fail' AND s = 'critical') AS c, count(*) FILTER (WHERE v = 'fail' AND s = 'cosmetic') AS m FROM e GROUP BY 1)
SELECT doc_id, CASE WHEN f > 0 THEN 'fail' WHEN p > 0 THEN 'pass' ELSE 'unresolved' END AS verdict, CASE WHEN f > 0 THEN CASE WHEN c = 0 AND m > 0 THEN 'cosmetic' ELSE 'critical' END END AS severity, f > 0 AND c = 0 AND m = 0 AS unclassified FROM p""", D)
def _(d):
    v = F.when(F.col("part_key") % 6 == 0, "FAIL").when(F.col("part_key") % 6 == 1, None).when(F.col("part_key") % 6 == 2, "maybe").otherwise("pass")
    s = F.when(F.col("supp_key") % 3 == 0, "critical").when(F.col("supp_key") % 3 == 1, "Cosmetic")
    return Q.audit_verdicts(d.select("doc_id", v.alias("verdict"), s.alias("severity")))


@_query("j28_attach_members", f"WITH i AS (SELECT doc_id, CASE WHEN max(order_key) % 31 = 0 THEN ' ' ELSE min(member) END AS member FROM {D} WHERE order_key % 17 <> 0 GROUP BY doc_id) SELECT d.doc_id, d.source_row_id, d.part_key, d.supp_key, i.member, CASE WHEN trim(coalesce(i.member, '')) = '' THEN 'no_index_row' END AS failed FROM {D} d LEFT JOIN i ON i.doc_id = d.doc_id", D)
def _(d):
    index = d.where("order_key % 17 <> 0").groupBy("doc_id").agg(F.when(F.max("order_key") % 31 == 0, " ").otherwise(F.min("member")).alias("member"), F.min("disclosure_date").alias("filing_date"))
    return Q.attach_members(d.select("doc_id", "source_row_id", "part_key", "supp_key"), index).select("doc_id", "source_row_id", "part_key", "supp_key", "member", "failed")


@_query("t07_accept_corrections", f"WITH n AS (SELECT {_RS}, count(*) AS n FROM {D} WHERE part_key % 4 <> 0 GROUP BY {_RS}), h AS (SELECT DISTINCT {_RS} FROM {D} WHERE part_key % 4 = 0) SELECT {_RS}, CASE WHEN hit THEN coalesce(n, 0) ELSE stated_count END AS stated_count, CASE WHEN hit THEN DATE '2002-01-01' ELSE parsed_at END AS parsed_at, hit AS rebound FROM (SELECT r.*, n.n, r.status = 'success' AND h.doc_id IS NOT NULL AS hit FROM {R} r LEFT JOIN n USING ({_RS}) LEFT JOIN h USING ({_RS}))", D, R)
def _(d, r):
    out = Q.accept_corrections(r, d.where("part_key % 4 <> 0"), d.where("part_key % 4 = 0"), _day("2002-01-01"))
    return out.select(*Q.ROWSET, "stated_count", "parsed_at", "rebound")


@_query("j15_carry_forward", f"WITH a AS (SELECT doc_id, max(order_key) AS o, min(member) AS m, CASE WHEN max(order_key) % 5 = 0 THEN NULL ELSE min(chamber) END AS c FROM {D} GROUP BY 1), same AS (SELECT doc_id FROM a WHERE o % 7 <> 0 AND o % 11 <> 0) SELECT doc_id, source_row_id, part_key, supp_key FROM {D} SEMI JOIN same USING (doc_id)", D)
def _(d):
    now = d.groupBy("doc_id").agg(F.max("order_key").alias("o"), F.min("member").alias("m"), F.min("chamber").alias("c")).withColumn("c", F.when(F.col("o") % 5 != 0, F.col("c"))).withColumn("artifact", F.sha2("doc_id", 256))
    before = now.withColumns({"artifact": F.when(F.col("o") % 7 == 0, "other").otherwise(F.col("artifact")), "m": F.when(F.col("o") % 11 == 0, None).otherwise(F.col("m"))})
    return Q.carry_forward(d, before, now, ["artifact", "m", "c"]).select("doc_id", "source_row_id", "part_key", "supp_key")


@_query("g43_freshness_report", f"WITH n AS (SELECT 'prices' AS input, max(date) AS newest, 3 AS lim FROM fx_prices WHERE date <= DATE '2001-08-20' UNION ALL SELECT 'filings:' || source, max(disclosure_date), 10 FROM {D} WHERE disclosure_date <= DATE '2001-08-20' GROUP BY source) SELECT input, newest, CASE WHEN newest IS NULL THEN 'unknown' WHEN date_diff('day', newest, DATE '2001-08-20') <= lim THEN 'pass' ELSE 'fail' END AS state FROM n", D, "fx_prices")
def _(d, p):
    return Q.freshness_report(p, d, _day("2001-08-20"), {"prices": 3, "filings": 10})


_STATED = f"""stated AS (SELECT doc_id AS source_record_id, source, chamber, ingestion_generation, o, n, CASE WHEN o % 19 = 0 THEN 'lost' WHEN o % 13 = 0 THEN 'failed' WHEN o % 11 = 0 THEN 'unavailable' WHEN o % 7 = 0 THEN 'paper_only' WHEN o % 5 = 0 THEN 'no_txs' ELSE 'parsed' END AS outcome FROM (SELECT doc_id, source, chamber, ingestion_generation, max(order_key) AS o, count(*) AS n FROM {D} GROUP BY ALL)),
reps AS (SELECT *, CASE WHEN o % 17 <> 0 THEN CASE WHEN outcome IN ('no_txs', 'paper_only') AND o % 2 = 0 THEN 0 ELSE n END END AS raw, CASE WHEN outcome IN ('no_txs', 'paper_only') AND o % 2 = 0 THEN 0 WHEN outcome = 'failed' THEN 0 ELSE n + CASE WHEN o % 23 = 0 THEN 1 ELSE 0 END END AS accepted, CASE WHEN outcome = 'failed' THEN n ELSE 0 END AS rejected,
 CASE WHEN o % 3 = 0 THEN NULL ELSE sha256(source_record_id) END AS artifact_sha256, CASE WHEN o % 29 = 0 THEN upper(sha256(source_record_id)) ELSE sha256(source_record_id) END AS landing_sha256,
 CASE WHEN outcome = 'paper_only' OR o % 31 = 0 THEN CASE o % 4 WHEN 0 THEN 'https://efdsearch.senate.gov/media/' || o WHEN 1 THEN 'http://efdsearch.senate.gov/media/' || o WHEN 2 THEN 'https://efdsearch.senate.gov:443/search/view/paper/' || o ELSE 'https://efdsearch.senate.gov/media/' || o || '?x=1' END END AS paper_url, CASE WHEN outcome = 'paper_only' THEN sha256(source_record_id || 'p') END AS paper_sha256 FROM stated)"""


def _stated(d: DataFrame) -> DataFrame:
    g = d.groupBy(F.col("doc_id").alias("source_record_id"), "source", "chamber", "ingestion_generation").agg(F.max("order_key").alias("o"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("outcome", F.expr("CASE WHEN o % 19 = 0 THEN 'lost' WHEN o % 13 = 0 THEN 'failed' WHEN o % 11 = 0 THEN 'unavailable' WHEN o % 7 = 0 THEN 'paper_only' WHEN o % 5 = 0 THEN 'no_txs' ELSE 'parsed' END"))
    empty = "outcome IN ('no_txs', 'paper_only') AND o % 2 = 0"
    return g.selectExpr(
        "source_record_id", "source", "chamber", "ingestion_generation", "outcome", f"CASE WHEN o % 17 <> 0 THEN CASE WHEN {empty} THEN 0 ELSE n END END AS raw", f"CASE WHEN {empty} THEN 0 WHEN outcome = 'failed' THEN 0 ELSE n + CASE WHEN o % 23 = 0 THEN 1 ELSE 0 END END AS accepted", "CASE WHEN outcome = 'failed' THEN n ELSE 0 END AS rejected",
        "CASE WHEN o % 3 = 0 THEN NULL ELSE sha2(source_record_id, 256) END AS artifact_sha256", "CASE WHEN o % 29 = 0 THEN upper(sha2(source_record_id, 256)) ELSE sha2(source_record_id, 256) END AS landing_sha256",
        "CASE WHEN outcome = 'paper_only' OR o % 31 = 0 THEN CASE o % 4 WHEN 0 THEN concat('https://efdsearch.senate.gov/media/', o) WHEN 1 THEN concat('http://efdsearch.senate.gov/media/', o) WHEN 2 THEN concat('https://efdsearch.senate.gov:443/search/view/paper/', o) ELSE concat('https://efdsearch.senate.gov/media/', o, '?x=1') END END AS paper_url",
        "CASE WHEN outcome = 'paper_only' THEN sha2(concat(source_record_id, 'p'), 256) END AS paper_sha256",
    )


_G = "ingestion_generation, source, chamber, source_record_id"
_BOUND = "coalesce(regexp_full_match(artifact_sha256, '[0-9a-f]{64}') AND artifact_sha256 = landing_sha256, false)"


@_query(
    "g35_report_equation_violations",
    f"""WITH {_STATED} SELECT 'row_counts' AS rule, {_G} FROM reps WHERE raw IS NULL OR (outcome = 'parsed' AND NOT (raw = accepted AND accepted > 0 AND rejected = 0)) OR (outcome IN ('no_txs', 'paper_only') AND NOT (raw = 0 AND accepted = 0 AND rejected = 0)) OR (outcome IN ('unavailable', 'failed') AND raw <> accepted + rejected)
UNION ALL SELECT 'no_txs_provenance', {_G} FROM reps WHERE outcome = 'no_txs' AND NOT (chamber = 'house' AND {_BOUND}) UNION ALL SELECT 'parsed_provenance', {_G} FROM reps WHERE outcome = 'parsed' AND NOT {_BOUND} UNION ALL SELECT 'paper_fields', {_G} FROM reps WHERE outcome <> 'paper_only' AND paper_url IS NOT NULL
UNION ALL SELECT 'paper_provenance', {_G} FROM reps WHERE outcome = 'paper_only' AND NOT (chamber = 'senate' AND {_BOUND} AND paper_url LIKE 'https://%' AND NOT contains(paper_url, '?')) UNION ALL SELECT 'stored_rows', {_G} FROM reps WHERE accepted <> n UNION ALL SELECT DISTINCT 'group_equation', ingestion_generation, source, chamber, NULL FROM reps WHERE outcome = 'lost'""",
    D,
)
def _(d):
    rows = d.select("ingestion_generation", "source", "chamber", F.col("doc_id").alias("source_record_id"), F.when(F.col("order_key") % 3 != 0, F.sha2("doc_id", 256)).alias("artifact_sha256"))
    return Q.report_equation_violations(_stated(d), rows)


@_query("g35_incomplete_groups", f"WITH {_STATED} SELECT ingestion_generation, source, chamber, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'unavailable') AS unavailable FROM reps GROUP BY 1, 2, 3 HAVING failed > 0 OR unavailable > 0", D)
def _(d):
    return Q.incomplete_groups(_stated(d))
