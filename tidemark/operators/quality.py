"""Which rowsets may publish rows, and what audits find: admission, reconciliation, coverage, violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TICKER_FORM, canonical_member_key, parse_disclosure_date

# Words that have the form of a ticker and are none.
RESERVED = ["COUPON", "BOND", "BONDS", "NOTE", "NOTES", "STOCK", "TICKER"]

ROWSET = ["doc_id", "source", "ingestion_generation"]
#: Sources whose rows need no accepted parse run.
DIRECT = ["senate_efd", "form4", "13f"]
FENCE = 142


def accepted_rowsets(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose rowset is as they state it: success with that many rows, at least one, none of them invalid;
    or invalid or no_txs with no row. Counts are taken once per rowset, then joined."""
    bad = F.col("transaction_date").isNull() | F.col("disclosure_date").isNull() | (F.col("transaction_date") > F.col("disclosure_date")) | (F.trim(F.coalesce("chamber", F.lit(""))) == "") | (F.trim(F.coalesce("source_row_id", F.lit(""))) == "")
    live = rows.groupBy(*ROWSET).agg(F.count(F.lit(1)).alias("live"), F.count_if(bad).alias("invalid"))
    both = runs.join(live, ROWSET, "left").withColumns({"live": F.coalesce("live", F.lit(0)), "invalid": F.coalesce("invalid", F.lit(0))})
    ok = (F.col("stated_count") == F.col("live")) & F.when(F.col("status") == "success", (F.col("live") > 0) & (F.col("invalid") == 0)).when(F.col("status").isin("invalid", "no_txs"), F.col("live") == 0).otherwise(False)
    return both.where(ok).drop("live", "invalid")


def latest_accepted_docs(accepted: DataFrame) -> DataFrame:
    """The newest promoted accepted run of each document in its archive year."""
    w = Window.partitionBy("archive_year", "doc_id").orderBy(F.desc("parsed_at"), "source", "ingestion_generation")
    return accepted.where("promoted").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prefer_producer(rows: DataFrame, preferred: str = "house_pdf", other: str = "gemini_ocr") -> DataFrame:
    """Rows of ``other`` go where the preferred family has rows of the same document and generation, nulls alike."""
    has = rows.where(F.col("source") == preferred).select(F.col("doc_id").alias("__d"), F.col("ingestion_generation").alias("__g")).distinct()
    return rows.join(has, (F.col("source") == other) & (F.col("doc_id") == F.col("__d")) & F.col("ingestion_generation").eqNullSafe(F.col("__g")), "left_anti")


def canonical_transactions(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of direct sources, and others of accepted promoted rowsets; trade not after disclosure; one producer."""
    good = accepted_rowsets(rows, runs).where("promoted AND status = 'success'").select(*ROWSET).distinct()
    direct = rows.where(F.col("source").isin(*DIRECT))
    admitted = rows.where(~F.col("source").isin(*DIRECT)).join(good, ROWSET, "left_semi")
    seen = direct.unionByName(admitted).where(F.coalesce(F.col("transaction_date") <= F.col("disclosure_date"), F.lit(True)))
    return prefer_producer(seen)


def rowset_watermark(rows: DataFrame) -> DataFrame:
    """When the newest row of each rowset came to be."""
    return rows.groupBy(*ROWSET).agg(F.max("created_at").alias("watermark"))


def as_of_acceptance(runs: DataFrame, rows: DataFrame, day: Column) -> DataFrame:
    """Runs accepted before the end of a day, and not older than the rows that they admit."""
    return runs.where(F.col("parsed_at") <= day).join(rowset_watermark(rows), ROWSET).where(F.col("parsed_at") >= F.col("watermark"))


def unresolved_documents(index: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents of the index without any accepted rowset."""
    return index.select("doc_id").distinct().join(accepted_rowsets(rows, runs).select("doc_id").distinct(), "doc_id", "left_anti")


def run_row_mismatches(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose stated count differs from the rows stored, or whose status forbids rows; with the reasons."""
    live = rows.groupBy(*ROWSET).agg(F.count(F.lit(1)).alias("live"))
    both = runs.join(live, ROWSET, "left").withColumn("live", F.coalesce("live", F.lit(0)))
    why = F.array_compact(F.array(F.when(F.col("stated_count") != F.col("live"), "count"), F.when((F.col("status") != "success") & (F.col("live") > 0), "status")))
    return both.withColumn("reasons", F.array_join(why, ",")).where("reasons <> ''").select(*ROWSET, "status", "stated_count", "live", "reasons")


def report_outcomes(runs: DataFrame) -> DataFrame:
    """Per source and generation how many runs ended how, and the rows that they state."""
    return runs.groupBy("source", "ingestion_generation").agg(F.count(F.lit(1)).alias("runs"), *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "invalid")), F.sum("stated_count").alias("stated"))


def work_selection(runs: DataFrame, fallback: str = "gemini_ocr") -> DataFrame:
    """Documents whose latest run of another extractor failed, with what the fallback has for them."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("parsed_at"), "source", "ingestion_generation")
    last = runs.where(F.col("source") != fallback).withColumn("__n", F.row_number().over(w)).where("__n = 1 AND status = 'failed'").select("doc_id", "parsed_at")
    have = runs.where(F.col("source") == fallback).groupBy("doc_id").agg(F.sum("stated_count").alias("fallback_rows"), F.max("parsed_at").alias("fallback_at"))
    return last.join(have, "doc_id", "left").withColumns({"fallback_rows": F.coalesce("fallback_rows", F.lit(0)), "stale": F.coalesce(F.col("fallback_at") < F.col("parsed_at"), F.lit(True))}).drop("fallback_at")


def canary_counts(rows: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned documents that do not have the pinned number of rows."""
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return pinned.join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> pinned")


def date_domain_violations(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with a date out of its domain, missing, or in the wrong order, one row per rule."""
    rules = {
        "trade_out_of_domain": ~F.col("transaction_date").between(F.lit(low).cast("date"), F.lit(high).cast("date")),
        "missing_date": F.col("transaction_date").isNull() | F.col("disclosure_date").isNull(),
        "trade_after_disclosure": F.col("transaction_date") > F.col("disclosure_date"),
    }
    each = F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))
    return rows.withColumn("rule", F.explode(each)).select("rule", "doc_id", "source_row_id", "part_key", "supp_key")


def audit_report(rows: DataFrame, runs: DataFrame, low: str, high: str) -> DataFrame:
    """C4: the number of violations of each rule over all audits; rules without any appear with none."""
    dates = date_domain_violations(rows, low, high).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    counts = run_row_mismatches(rows, runs).withColumn("rule", F.explode(F.split("reasons", ","))).groupBy(F.concat(F.lit("run_"), F.col("rule")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([(r,) for r in ("trade_out_of_domain", "missing_date", "trade_after_disclosure", "run_count", "run_status")], "rule string")
    return names.join(dates.unionByName(counts), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("violations"), F.col("n").isNull().alias("passed"))


def oversized_report_quarantine(rows: DataFrame, fence: int = FENCE) -> DataFrame:
    """rows of reports with more rows than the fence get the reason; others have none."""
    big = rows.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("report_rows")).where(F.col("report_rows") > fence)
    return rows.join(big, ["doc_id", "source"], "left").withColumn("quarantine", F.when(F.col("report_rows").isNotNull(), "oversized_report"))


def no_future_rows(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows with any date after the decision; none is a pass."""
    return rows.where(F.greatest("transaction_date", "disclosure_date") > as_of)


def inventory_coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Per year how many expected ids are covered, missing, or present without being expected."""
    both = expected.select("year", "doc_id").distinct().withColumn("e", F.lit(1)).join(present.select("year", "doc_id").distinct().withColumn("p", F.lit(1)), ["year", "doc_id"], "full_outer")
    return both.groupBy("year").agg(F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("covered"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("orphan"))


def join_outcomes(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """How many keys of two panels match, are on one side only, or occur twice."""
    a = left.groupBy(*key).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))


def compare_readings(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Per document how many rows one reading has over the other, as multisets."""
    n = a.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("a"))
    m = b.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("b"))
    both = n.join(m, ["doc_id", *key], "full_outer").select("doc_id", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d"))
    return both.groupBy("doc_id").agg(F.sum(F.greatest("d", F.lit(0))).alias("only_in_a"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("only_in_b")).withColumn("equal", (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0))


def merge_extractions(rows: DataFrame, key: list[str]) -> DataFrame:
    """The union of several extractors' rows per document, each key as often as the extractor with most of it has it."""
    per = rows.groupBy("doc_id", "source", *key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("doc_id", *key).agg(F.max("n").alias("copies"), F.count(F.lit(1)).alias("extractors"), (F.max("n") != F.min("n")).alias("disagree"))


def extraction_quality(rows: DataFrame) -> DataFrame:
    """Per document and extractor the share of rows with an amount and a date in order."""
    return rows.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("rows"), F.avg(((F.col("amount_midpoint") > 0) & (F.col("transaction_date") <= F.col("disclosure_date"))).cast("double")).alias("quality"))


def reconcile_exact_keys(wanted: DataFrame, offered: DataFrame, key: list[str], value: str) -> DataFrame:
    """Proposes a value where the key is unique on both sides; every other row has the reason."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    mine = wanted.withColumn("__mine", n)
    theirs = offered.groupBy(*key).agg(F.count(F.lit(1)).alias("__theirs"), F.min(value).alias("__value"))
    out = mine.join(theirs, key, "left")
    reason = F.when(F.col("__theirs").isNull(), "no_match").when(F.col("__mine") > 1, "repeated_here").when(F.col("__theirs") > 1, "repeated_there")
    return out.withColumns({"proposal": F.when(reason.isNull(), F.col("__value")), "reason": reason}).drop("__mine", "__theirs", "__value")


def preserve_resolved_fields(new: DataFrame, earlier: DataFrame, key: list[str], field: str) -> DataFrame:
    """Blank fields take the earlier value of the same row, if all earlier ones agree."""
    known = earlier.where(F.col(field).isNotNull()).groupBy(*key).agg(F.count_distinct(field).alias("__n"), F.min(field).alias("__v"))
    return new.join(known, key, "left").withColumn(field, F.coalesce(field, F.when(F.col("__n") == 1, F.col("__v")))).drop("__n", "__v")


def compare_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tickers added, removed or changed between two coverage tables (ticker, days)."""
    both = a.select("ticker", F.col("days").alias("before")).join(b.select("ticker", F.col("days").alias("after")), "ticker", "full_outer")
    what = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", what).where("change IS NOT NULL")


def served_prices(values: DataFrame, state: DataFrame) -> DataFrame:
    """Closes of the generation that is served for each ticker, where it is comparable."""
    good = state.where("comparable").select("ticker", F.col("served").alias("generation"), "basis")
    return values.join(good, ["ticker", "generation"])


def decision_quote(base: DataFrame, newer: DataFrame, most_days: int = 5) -> DataFrame:
    """The base quote; where it is too old, a newer one of the served comparable generation. No base quote, no quote.

    Both sides as (ticker, day, quote_date, quote); ``newer`` is taken from ``served_prices``.
    """
    both = base.join(newer.select("ticker", "day", F.col("quote_date").alias("d2"), F.col("quote").alias("q2")), ["ticker", "day"], "left")
    take = F.coalesce((F.datediff("day", "quote_date") > most_days) & (F.col("d2") > F.col("quote_date")), F.lit(False))
    return both.select("ticker", "day", F.when(take, F.col("d2")).otherwise(F.col("quote_date")).alias("quote_date"), F.when(take, F.col("q2")).otherwise(F.col("quote")).alias("quote"), take.alias("from_newer"))


def unpromoted_rows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose document has no accepted promoted rowset."""
    good = accepted_rowsets(rows, runs).where("promoted").select("doc_id").distinct()
    return rows.where(~F.col("source").isin(*DIRECT)).join(good, "doc_id", "left_anti")


def triage_priority(docs: DataFrame) -> DataFrame:
    """Recency rank of the filing day among all days times the member's prominence (1 at least), with both.

    ``docs`` has doc_id, filing_date and prominence. Only the days are put in order, a list as long as a calendar.
    """
    days = docs.select("filing_date").where("filing_date IS NOT NULL").distinct().withColumn("recency_rank", F.row_number().over(Window.orderBy("filing_date")))
    out = docs.join(days, "filing_date", "left").withColumns({"recency_rank": F.coalesce("recency_rank", F.lit(0)), "prominence": F.greatest(F.lit(1), F.coalesce("prominence", F.lit(0)))})
    return out.withColumn("priority", F.col("prominence") * F.col("recency_rank"))


def scope_status(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """Per generation the documents expected, done and open; a document's state is the best that one of its runs has."""
    rank = F.when(F.col("status") == "success", 0).when(F.col("status") == "invalid", 1).otherwise(2)
    state = runs.groupBy("ingestion_generation", "doc_id").agg(F.min(rank).alias("state"))
    both = expected.select("ingestion_generation", "doc_id").distinct().join(state, ["ingestion_generation", "doc_id"], "left")
    return both.groupBy("ingestion_generation").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("state") == 0).alias("done"), F.count_if(F.col("state") == 1).alias("rejected"), F.count_if(F.col("state").isNull() | (F.col("state") == 2)).alias("open"))


def completeness_scope(index: DataFrame, runs: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Per group the documents of index, runs and rows, those not in the index, and whether all agree."""
    per = lambda df, n: df.select(by, "doc_id").distinct().withColumn(n, F.lit(1))
    both = per(index, "i").join(per(runs, "r"), [by, "doc_id"], "full_outer").join(per(rows, "w"), [by, "doc_id"], "full_outer")
    out = both.groupBy(by).agg(F.count("i").alias("indexed"), F.count("r").alias("parsed"), F.count("w").alias("stored"), F.count_if(F.col("i").isNull()).alias("unexpected"))
    return out.withColumn("complete", (F.col("indexed") == F.col("parsed")) & (F.col("indexed") == F.col("stored")) & (F.col("unexpected") == 0))


def ticker_origin_violations(rows: DataFrame) -> DataFrame:
    """Rows whose ticker, candidate and raw ticker do not go with their ticker_origin, with the rule."""
    valid = lambda c: F.coalesce(c.rlike(TICKER_FORM), F.lit(False))
    reserved = lambda c: F.coalesce(c.isin(*RESERVED), F.lit(False))
    ticker, candidate, origin = F.col("ticker"), F.col("ticker_candidate"), F.col("ticker_origin")
    raw = F.nullif(F.upper(F.trim("raw_ticker")), F.lit(""))
    blank = raw.isNull() | (raw == "--")
    inferred = F.when(candidate.isNull(), ~blank & ~(valid(raw) & ~reserved(raw))).otherwise(blank)
    ok = (
        F.when(origin == "official", valid(ticker) & candidate.isNull() & F.coalesce(raw == ticker, F.lit(False)))
        .when(origin == "asset_description", valid(ticker) & ~reserved(ticker) & candidate.isNull() & blank)
        .when(origin == "unverified", ticker.isNull() & valid(candidate) & ~reserved(candidate) & blank)
        .when(origin.isin("non_equity", "missing"), ticker.isNull() & candidate.isNull() & blank)
        .when(origin == "invalid", ticker.isNull() & ~(valid(candidate) & ~reserved(candidate)) & inferred)
    )
    rule = F.when(ok.isNull(), "unknown_origin").when(~ok, F.concat(origin, F.lit("_inconsistent")))
    return rows.withColumn("rule", F.explode(F.array_compact(F.array(rule))))  # a filter would hold the rule twice


GROUP = ["ingestion_generation", "source", "chamber"]
OUTCOMES = ["parsed", "no_txs", "paper_only", "unavailable", "failed"]
# Where paper filings are published, and the form of a SHA-256.
PAPER_URL = "(?i)^https://efdsearch\\.senate\\.gov(?::443)?(?-i)/(?:media|search/view/paper|search/view/paper-filing)/[^?#]*$"
HEX_64 = "^[0-9a-f]{64}$"


def report_equation_violations(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups with reports of no known outcome, and reports whose counts, hashes or stored rows break a rule; one row per rule.

    ``reports`` has GROUP, source_record_id, outcome, raw, accepted, rejected, artifact_sha256, landing_sha256,
    paper_url and paper_sha256; ``rows`` has GROUP, source_record_id and artifact_sha256. A group's row has no record id.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    hashed = lambda c: F.col(c).rlike(HEX_64)
    raw, accepted, rejected, outcome, chamber = F.col("raw"), F.col("accepted"), F.col("rejected"), F.col("outcome"), F.lower(F.trim("chamber"))
    bound = hashed("artifact_sha256") & hashed("landing_sha256") & (F.col("artifact_sha256") == F.col("landing_sha256"))
    counts = F.when(outcome == "parsed", (raw == accepted) & (accepted > 0) & (rejected == 0)).when(outcome.isin("no_txs", "paper_only"), (raw == 0) & (accepted == 0) & (rejected == 0)).when(outcome.isin("unavailable", "failed"), raw == accepted + rejected).otherwise(raw.isNotNull() & accepted.isNotNull() & rejected.isNotNull())
    stored = rows.groupBy(*GROUP[:2], F.lower("chamber").alias("low"), "source_record_id", F.col("artifact_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("live"))
    r = reports.alias("r").join(stored.alias("s"), (F.col("r.ingestion_generation") == F.col("s.ingestion_generation")) & (F.col("r.source") == F.col("s.source")) & (F.lower("r.chamber") == F.col("s.low")) & (F.col("r.source_record_id") == F.col("s.source_record_id")) & F.col("r.artifact_sha256").eqNullSafe(F.col("s.sha")), "left").select("r.*", F.coalesce("s.live", F.lit(0)).alias("live"))
    rules = {
        "row_counts": no(counts),
        "no_txs_provenance": (outcome == "no_txs") & no((chamber == "house") & bound),
        "parsed_provenance": (outcome == "parsed") & no(bound),
        "paper_fields": (outcome != "paper_only") & (F.col("paper_url").isNotNull() | F.col("paper_sha256").isNotNull()),
        "paper_provenance": (outcome == "paper_only") & no((chamber == "senate") & bound & hashed("paper_sha256") & F.col("paper_url").rlike(PAPER_URL)),
        "stored_rows": accepted != F.col("live"),
    }
    each = r.withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items()))))).select("rule", *GROUP, "source_record_id")
    groups = reports.groupBy(*GROUP).agg(F.count_if(no(outcome.isin(*OUTCOMES))).alias("n")).where("n > 0")
    return each.unionByName(groups.select(F.lit("group_equation").alias("rule"), *GROUP, F.lit(None).cast("string").alias("source_record_id")))


def incomplete_groups(reports: DataFrame) -> DataFrame:
    """Groups with failed or unavailable reports, and how many."""
    per = reports.groupBy(*GROUP).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("failed", "unavailable")))
    return per.where("failed > 0 OR unavailable > 0")


def report_violations(reports: DataFrame, generation: str, chamber: str) -> DataFrame:
    """(rule, report_id), one row per rule that a report of a replacement breaks.

    ``reports``: ingestion_generation, chamber, source_record_id, outcome, raw, accepted and rejected (row counts), artifact_sha256, landing_sha256,
    paper_artifact_sha256, paper_artifact_url, report_path, member, filed_text. Outcomes are parsed, no_txs, paper_only, unavailable and
    failed; a replacement may hold none of the last two.
    """
    raw, ok, no = (F.col(c).cast("double") for c in ("raw", "accepted", "rejected"))
    is_ = lambda x: F.coalesce(F.col("outcome") == x, F.lit(False))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    whole = lambda c: F.coalesce((c >= 0) & (c % 1 == 0), F.lit(False))
    same = F.coalesce(F.col("artifact_sha256") == F.col("landing_sha256"), F.lit(False))
    hashed = lambda c: F.col(c).isNull() | F.col(c).rlike("^[0-9a-f]{64}$")
    house = lambda x: F.coalesce(F.lower(F.trim("chamber")) == x, F.lit(False))
    paper = is_("paper_only")
    none = (raw == 0) & (ok == 0) & (no == 0)
    again = reports.groupBy("source_record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source_record_id", F.lit(True).alias("__again"))
    reports, twice = reports.join(again, "source_record_id", "left"), F.col("__again")
    known = is_("parsed") | is_("no_txs") | paper | is_("unavailable") | is_("failed")
    url = F.coalesce(F.col("paper_artifact_url").rlike("^https://(?i:efdsearch\\.senate\\.gov)(?::443)?(?:/media/|/search/view/paper/|/search/view/paper-filing/)[^?#]*$"), F.lit(False))
    rules = {
        "required": F.col("ingestion_generation").isNull() | F.col("chamber").isNull() | F.col("source_record_id").isNull() | F.col("outcome").isNull(),
        "other_generation": F.col("ingestion_generation") != generation, "other_chamber": F.col("chamber") != chamber, "blank_id": empty("source_record_id"), "repeated_id": twice,
        "counts": ~(whole(raw) & whole(ok) & whole(no)), "hash_form": ~(hashed("artifact_sha256") & hashed("landing_sha256") & hashed("paper_artifact_sha256")),
        "parsed_counts": is_("parsed") & ((ok <= 0) | (no != 0) | (raw != ok)), "parsed_hashes": is_("parsed") & ~same,
        "no_txs_chamber": is_("no_txs") & ~house("house"), "no_txs_counts": is_("no_txs") & ~none, "no_txs_hashes": is_("no_txs") & ~same,
        "paper_chamber": paper & ~house("senate"), "paper_counts": paper & ~none, "paper_hashes": paper & (~same | F.col("paper_artifact_sha256").isNull()), "paper_url": paper & ~url,
        "paper_fields": ~paper & (F.col("paper_artifact_url").isNotNull() | F.col("paper_artifact_sha256").isNotNull()),
        "count_equation": known & ~is_("parsed") & ~paper & (raw != ok + no), "unknown_outcome": F.col("outcome").isNotNull() & ~known, "not_replaceable": is_("unavailable") | is_("failed"),
        "report_path": empty("report_path"), "member": empty("member") | (F.col("member") != F.trim("member")), "filing_date": parse_disclosure_date(F.col("filed_text")).isNull(),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))
    return reports.withColumn("rules", broken).select(F.explode("rules").alias("rule"), F.col("source_record_id").alias("report_id"))


def report_binding_violations(rows: DataFrame, reports: DataFrame, source: str, chamber: str) -> DataFrame:
    """(report_id, reasons) of reports whose rows are not those they accepted: path, member and its keys, document, hash, dates, number, outcome.

    ``rows``: source_record_id, source_report_path, doc_id, member, member_key, chamber_member_key, artifact_sha256, official_filing_date, available_date,
    disclosure_date; ``reports``: source_record_id, report_path, member, landing_sha256, official_filing_date, accepted, outcome. Every
    binding is a flag of a row, so that rows are aggregated once before they are told; a date that is missing is a violation.
    """
    r = reports.select("source_record_id", *(F.col(c).alias(f"__{c}") for c in ("report_path", "member", "landing_sha256", "official_filing_date", "accepted", "outcome")), F.lit(True).alias("__known"))
    met = rows.join(r, "source_record_id", "full_outer").withColumn("__row", F.col("doc_id").isNotNull() | F.col("member").isNotNull() | F.col("source_report_path").isNotNull())
    key = canonical_member_key(F.col("member"))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    dates = ("official_filing_date", "available_date", "disclosure_date")
    missing = F.col("__official_filing_date").isNull()
    other = F.lit(False)
    for d in dates:
        missing, other = missing | F.col(d).isNull(), other | (F.col(d) != F.col("__official_filing_date"))
    told = F.col("__known") & F.col("__row")
    flags = {
        "no_report": F.col("__known").isNull(), "path": told & differs("source_report_path", "__report_path"), "member": told & differs("member", "__member"),
        "member_keys": told & (~F.col("member_key").eqNullSafe(key) | ~F.col("chamber_member_key").eqNullSafe(F.concat(F.lit(f"{chamber.strip().lower()}:"), key))),
        "doc_id": told & F.lit(source == "senate_efd") & differs("doc_id", "source_record_id"), "hash": told & differs("artifact_sha256", "__landing_sha256"),
        "dates": told & missing, "date": told & ~missing & F.coalesce(other, F.lit(False)),
    }
    path = F.concat(F.lit("/search/view/ptr/"), F.col("source_record_id"), F.lit("/"))
    form = F.col("source_record_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") & (F.col("__path") == path)
    per = met.groupBy("source_record_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()), F.count_if("__row").alias("stored"), F.max("__accepted").alias("__accepted"), F.max("__outcome").alias("__outcome"), F.max("__report_path").alias("__path"), F.bool_or("__known").alias("__known"))
    more = {
        "report_path": F.col("__known") & F.lit(source == "senate_efd") & ~F.coalesce(form, F.lit(False)), "count": F.col("__known") & (F.col("stored") != F.col("__accepted")),
        "outcome": F.col("__known") & (F.col("stored") > 0) & ~F.coalesce(F.col("__outcome") == "parsed", F.lit(False)),
    }
    why = F.array_compact(F.array(*(F.when(F.col(n), n) for n in flags), *(F.when(F.coalesce(c, F.lit(False)), n) for n, c in more.items())))
    return per.select(F.col("source_record_id").alias("report_id"), F.array_join(why, ",").alias("reasons")).where("reasons <> ''")


def audit_verdicts(entries: DataFrame) -> DataFrame:
    """Per document fail if any entry fails, else pass if any passes, else unresolved; a failure is critical unless only explicit cosmetic ones are told.

    ``entries``: doc_id, verdict and severity in any case; what is neither counts as not told.
    """
    v, sev = F.lower("verdict"), F.lower("severity")
    fail = F.coalesce(v == "fail", F.lit(False))
    per = entries.groupBy("doc_id").agg(F.bool_or(fail).alias("f"), F.bool_or(F.coalesce(v == "pass", F.lit(False))).alias("p"), F.bool_or(fail & F.coalesce(sev == "critical", F.lit(False))).alias("c"), F.bool_or(fail & F.coalesce(sev == "cosmetic", F.lit(False))).alias("m"))
    severity = F.when(F.col("f"), F.when(F.col("m") & ~F.col("c"), "cosmetic").otherwise("critical"))
    return per.select("doc_id", F.when(F.col("f"), "fail").when(F.col("p"), "pass").otherwise("unresolved").alias("verdict"), severity.alias("severity"), (F.col("f") & ~F.col("c") & ~F.col("m")).alias("unclassified"))


def attach_members(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """Parsed rows with the member and filing date of their document's index row; without one the document fails as a whole."""
    one = index.select("doc_id", "member", "filing_date").dropDuplicates(["doc_id"])
    return parsed.join(one, "doc_id", "left").withColumn("failed", F.when(F.trim(F.coalesce("member", F.lit(""))) == "", "no_index_row"))


def accept_corrections(runs: DataFrame, rows: DataFrame, repaired: DataFrame, now: Column) -> DataFrame:
    """After a repair, success runs of repaired rowsets take the number of rows now stored and the time; others stay as they are."""
    n = rows.groupBy(*ROWSET).agg(F.count(F.lit(1)).alias("__n"))
    touched = repaired.select(*ROWSET).distinct().withColumn("__hit", F.lit(True))
    both = runs.join(touched, ROWSET, "left").join(n, ROWSET, "left")
    hit = F.coalesce(F.col("__hit") & (F.col("status") == "success"), F.lit(False))
    return both.withColumns({"stated_count": F.when(hit, F.coalesce("__n", F.lit(0))).otherwise(F.col("stated_count")), "parsed_at": F.when(hit, now).otherwise(F.col("parsed_at")), "rebound": hit}).drop("__hit", "__n")


def carry_forward(previous: DataFrame, index_before: DataFrame, index_now: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of the generation before whose document's artifact and index fields are the same now, nulls alike."""
    a = index_before.select("doc_id", *(F.col(c).alias(f"__{c}") for c in fields))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    kept = index_now.select("doc_id", *fields).join(a, "doc_id").where(same).select("doc_id").distinct()
    return previous.join(kept, "doc_id", "left_semi")


def freshness_report(prices: DataFrame, rows: DataFrame, as_of: Column, limits: dict[str, int]) -> DataFrame:
    """Per input the newest date and pass, fail or unknown against its limit in days."""
    newest = prices.where(F.col("date") <= as_of).agg(F.lit("prices").alias("input"), F.max("date").alias("newest"))
    filings = rows.where(F.col("disclosure_date") <= as_of).groupBy(F.concat(F.lit("filings:"), F.col("source")).alias("input")).agg(F.max("disclosure_date").alias("newest"))
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.substring_index("input", ":", 1)]
    age = F.datediff(as_of, "newest")
    return newest.unionByName(filings).withColumn("state", F.when(F.col("newest").isNull(), "unknown").when(age <= limit, "pass").otherwise("fail"))
