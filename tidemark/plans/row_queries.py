"""Queries of the row-identity and statistics operators over the fixture views, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rows as R
from ..operators import stats as T
from ..sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
D, O = "fx_disclosures", "fx_outcomes"
_ID = "source, chamber, source_record_id, source_row_id, ingestion_generation"
_ORDER = "disclosure_date DESC, part_key, supp_key, amount_midpoint"


def _order() -> list:
    return [F.desc("disclosure_date"), F.asc("part_key"), F.asc("supp_key"), F.asc("amount_midpoint")]


def _query(name: str, sql: str | None, *views: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


@_query("w01_latest_per_key", f"SELECT doc_id, source, disclosure_date, part_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY {_ORDER}) AS k FROM {D}) WHERE k = 1", D)
def _(d):
    return R.latest_per_key(d, ["doc_id", "source"], _order()).select("doc_id", "source", "disclosure_date", "part_key")


@_query("w02_phantom_duplicates", f"SELECT doc_id, source_row_id, part_key, copy_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source_row_id, coalesce(raw_transaction_subtype, '') ORDER BY {_ORDER}) AS copy_number FROM {D}) WHERE copy_number > 1", D)
def _(d):
    return R.phantom_duplicates(d, ["doc_id", "source_row_id", "raw_transaction_subtype"], _order()).select("doc_id", "source_row_id", "part_key", "copy_number")


_BLANK = "CASE WHEN order_key % 7 = 0 THEN '' ELSE source_record_id END"


@_query("w03_dedupe_identity", f"SELECT doc_id, source_row_id, part_key, supp_key FROM (SELECT *, {_BLANK} AS rec, row_number() OVER (PARTITION BY source, chamber, {_BLANK}, source_row_id, ingestion_generation, CASE WHEN ({_BLANK}) = '' THEN 1 ELSE 0 END ORDER BY {_ORDER}) AS k FROM {D}) WHERE rec = '' OR k = 1", D)
def _(d):
    blank = d.withColumn("source_record_id", F.when(F.col("order_key") % 7 == 0, "").otherwise(F.col("source_record_id")))
    return R.dedupe_identity(blank, _order()).select("doc_id", "source_row_id", "part_key", "supp_key")


@_query("w04_flag_economic_duplicates", f"SELECT doc_id, source_row_id, part_key, supp_key, count(*) OVER (PARTITION BY member, ticker, transaction_date, transaction_type, owner_code, asset_description) > 1 AS economic_duplicate_candidate FROM {D}", D)
def _(d):
    return R.flag_economic_duplicates(d).select("doc_id", "source_row_id", "part_key", "supp_key", "economic_duplicate_candidate")


@_query("w05_collapse_episodes", f"SELECT member, ticker, disclosure_date, raw_transaction_subtype, part_key, episode_rows FROM (SELECT *, count(*) OVER w AS episode_rows, row_number() OVER (w ORDER BY {_ORDER}) AS k FROM {D} WINDOW w AS (PARTITION BY member, ticker, disclosure_date, raw_transaction_subtype)) WHERE k = 1", D)
def _(d):
    return R.collapse_episodes(d, ["member", "ticker", "disclosure_date", "raw_transaction_subtype"], _order()).select("member", "ticker", "disclosure_date", "raw_transaction_subtype", "part_key", "episode_rows")


@_query("w15_retain_terminal_runs", f"SELECT doc_id, source_row_id, part_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (transaction_type <> 'Exchange')::INT DESC, disclosure_date DESC, part_key DESC, supp_key DESC) AS k FROM {D}) WHERE k = 1", D)
def _(d):
    tie = d.withColumn("tie", F.struct("part_key", "supp_key"))
    return R.retain_terminal_runs(tie, ["doc_id"], F.col("transaction_type") != "Exchange", "disclosure_date", "tie").select("doc_id", "source_row_id", "part_key")


@_query("w16_stratified_sample", f"SELECT year, doc_id, flagged, place FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY flagged::INT DESC, sha256('s7' || doc_id), doc_id) AS place FROM (SELECT extract(year FROM min(disclosure_date))::INT AS year, doc_id, bool_or(transaction_date > disclosure_date) AS flagged FROM {D} GROUP BY doc_id)) WHERE place <= 20", D)
def _(d):
    docs = d.groupBy("doc_id").agg(F.year(F.min("disclosure_date")).alias("year"), F.bool_or(F.col("transaction_date") > F.col("disclosure_date")).alias("flagged"))
    return R.stratified_sample(docs, "year", "flagged", "doc_id", 20, "s7")


@_query("w17_verify_hash_chain", f"WITH l AS (SELECT member, tx_id, sha256(tx_id::VARCHAR) AS line_hash FROM fx_purchases), c AS (SELECT *, lag(line_hash) OVER (PARTITION BY member ORDER BY tx_id) AS expected FROM l), p AS (SELECT *, CASE WHEN tx_id % 11 = 0 THEN 'broken' ELSE expected END AS previous_hash FROM c) SELECT member, tx_id, previous_hash, expected FROM p WHERE previous_hash IS DISTINCT FROM expected", "fx_purchases")
def _(p):
    lines = p.select("member", "tx_id", F.sha2(F.col("tx_id").cast("string"), 256).alias("line_hash"))
    before = F.lag("line_hash").over(Window.partitionBy("member").orderBy("tx_id"))
    return R.verify_hash_chain(lines.withColumn("previous_hash", F.when(F.col("tx_id") % 11 == 0, "broken").otherwise(before)), "member", "tx_id")


@_query("w20_order_identity", f"SELECT tx_id, member, ticker, row_number() OVER (PARTITION BY member, ticker ORDER BY transaction_date NULLS FIRST, disclosure_date, source, source_record_id, source_row_id, owner_code, part_key, supp_key, amount_midpoint) AS place FROM fx_purchases", "fx_purchases")
def _(p):
    return R.order_identity(p, ["member", "ticker"]).select("tx_id", "member", "ticker", "place")


_VERSIONS = f"SELECT doc_id, source_row_id, part_key, supp_key, disclosure_date + 1 AS created_at, CASE WHEN part_key % 3 = 0 THEN disclosure_date + 1 + (part_key % 90)::INT END AS retired_at FROM {D}"


def _versions(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "source_row_id", "part_key", "supp_key", F.date_add("disclosure_date", 1).alias("created_at"), F.when(F.col("part_key") % 3 == 0, F.date_add(F.date_add("disclosure_date", 1), (F.col("part_key") % 90).cast("int"))).alias("retired_at"))


@_query("u01_j05_as_of_rows", f"SELECT doc_id, source_row_id, part_key, supp_key FROM ({_VERSIONS}) WHERE created_at < DATE '1998-06-02' AND (retired_at IS NULL OR retired_at >= DATE '1998-06-02')", D)
def _(d):
    v = _versions(d)
    both = R.union_versions(v.where("retired_at IS NULL").drop("retired_at"), v.where("retired_at IS NOT NULL"))
    return R.as_of_rows(both, F.lit("1998-06-02").cast("date")).select("doc_id", "source_row_id", "part_key", "supp_key")


@_query("w19_row_version_history", f"SELECT doc_id, source_row_id, seen, lead(seen) OVER (PARTITION BY doc_id, source_row_id ORDER BY seen) AS valid_to FROM (SELECT DISTINCT doc_id, source_row_id, disclosure_date AS seen FROM {D})", D)
def _(d):
    return R.row_version_history(d.select("doc_id", "source_row_id", F.col("disclosure_date").alias("seen")).distinct(), ["doc_id", "source_row_id"], "seen")


@_query("u02_changed_rows", f"SELECT doc_id, ticker, owner_code FROM {D} WHERE disclosure_date < DATE '1998-01-01' EXCEPT SELECT doc_id, ticker, CASE WHEN part_key % 5 = 0 THEN 'DC' ELSE owner_code END FROM {D} WHERE disclosure_date < DATE '1998-01-01'", D)
def _(d):
    a = d.where("disclosure_date < DATE '1998-01-01'").select("doc_id", "ticker", "owner_code", "part_key")
    return R.changed_rows(a.drop("part_key"), a.withColumn("owner_code", F.when(F.col("part_key") % 5 == 0, "DC").otherwise(F.col("owner_code"))).drop("part_key"))


@_query("u03_tables_equal", f"WITH a AS (SELECT ticker, source FROM {D}), b AS (SELECT CASE WHEN part_key % 3 = 0 THEN 'ZZ' ELSE ticker END AS ticker, source FROM {D}) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_in_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_in_b", D)
def _(d):
    return R.tables_equal(d.select("ticker", "source"), d.select(F.when(F.col("part_key") % 3 == 0, "ZZ").otherwise(F.col("ticker")).alias("ticker"), "source"))


_FK = "source, chamber, source_record_id, source_row_id"


@_query("u04_merge_append_only", f"WITH s AS (SELECT {_FK}, part_key FROM {D} WHERE part_key % 2 = 0), n AS (SELECT {_FK}, part_key FROM {D} WHERE part_key % 2 <> 0) SELECT * FROM s UNION ALL SELECT * FROM n WHERE ({_FK}) NOT IN (SELECT {_FK} FROM s)", D)
def _(d):
    cols = [*R.FILING, "part_key"]
    return R.merge_append_only(d.where("part_key % 2 = 0").select(*cols), d.where("part_key % 2 <> 0").select(*cols))


@_query("u05_merge_chunks", f"SELECT doc_id, source_row_id, count(*) AS n, count(DISTINCT (ticker, owner_code)) AS contents, count(DISTINCT (ticker, owner_code)) > 1 AS conflict FROM (SELECT * FROM {D} WHERE part_key % 2 = 0 UNION ALL SELECT * FROM {D} WHERE part_key % 2 <> 0 OR part_key % 3 = 1) GROUP BY 1, 2", D)
def _(d):
    c = d.select("doc_id", "source_row_id", "ticker", "owner_code", "part_key")
    return R.merge_chunks([c.where("part_key % 2 = 0").drop("part_key"), c.where("part_key % 2 <> 0 OR part_key % 3 = 1").drop("part_key")], ["doc_id", "source_row_id"])


@_query("u07_multiset_subset", f"SELECT ticker, source, n_a, coalesce(n_b, 0) AS n_b FROM (SELECT ticker, source, count(*) AS n_a FROM {D} WHERE part_key % 2 = 0 GROUP BY 1, 2) LEFT JOIN (SELECT ticker, source, count(*) AS n_b FROM {D} WHERE part_key % 2 <> 0 GROUP BY 1, 2) USING (ticker, source) WHERE n_a > coalesce(n_b, 0)", D)
def _(d):
    return R.multiset_subset(d.where("part_key % 2 = 0"), d.where("part_key % 2 <> 0"), ["ticker", "source"])


@_query("u08_common_dates", f"SELECT disclosure_date FROM {D} WHERE source = 'form4' INTERSECT SELECT disclosure_date FROM {D} WHERE source = 'senate_efd'", D)
def _(d):
    return R.common_dates(d.where("source = 'form4'"), d.where("source = 'senate_efd'"), "disclosure_date")


_ONE = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY {_ORDER}) AS k FROM {D} WHERE {{}}) WHERE k = 1)"


@_query(
    "t01_upsert_by_identity",
    f"SELECT {_ID}, CASE WHEN n.k IS NOT NULL THEN n.disclosure_date ELSE s.disclosure_date END AS disclosure_date, coalesce(s.raw_transaction_subtype, n.raw_transaction_subtype) AS raw_transaction_subtype, CASE WHEN s.k IS NULL THEN 'inserted' WHEN n.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM {_ONE.format('part_key % 3 <> 0')} s FULL JOIN {_ONE.format('(part_key % 2 = 0 OR part_key % 3 = 0)')} n USING ({_ID})",
    D,
)
def _(d):
    cols = [*R.IDENTITY, "disclosure_date", "raw_transaction_subtype"]
    one = lambda c: R.latest_per_key(d.where(c), R.IDENTITY, _order()).select(*cols)
    return R.upsert_by_identity(one("part_key % 3 <> 0"), one("(part_key % 2 = 0 OR part_key % 3 = 0)"), ["disclosure_date"])


@_query("t02_drop_already_stored", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY {_FK} ORDER BY part_key) AS k FROM (SELECT {_FK}, part_key FROM {D} WHERE part_key % 2 <> 0)) SELECT {_FK}, part_key FROM n WHERE k = 1 AND ({_FK}) NOT IN (SELECT {_FK} FROM {D} WHERE part_key % 2 = 0)", D)
def _(d):
    cols = [*R.FILING, "part_key"]
    return R.drop_already_stored(d.where("part_key % 2 = 0").select(*cols), d.where("part_key % 2 <> 0").select(*cols))


@_query("t03_replace_documents", f"WITH n AS (SELECT doc_id, ticker, 'new' AS origin FROM {D} WHERE order_key % 5 = 0 AND line_number = 1) SELECT doc_id, ticker, 'old' AS origin FROM {D} WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n", D)
def _(d):
    new = d.where("order_key % 5 = 0 AND line_number = 1").select("doc_id", "ticker", F.lit("new").alias("origin"))
    return R.replace_documents(d.select("doc_id", "ticker", F.lit("old").alias("origin")), new)


@_query("t05_upsert_last_wins", "WITH o AS (SELECT ticker, date, max(close) AS close FROM fx_prices WHERE date < DATE '1997-01-01' OR ticker >= 'TH' GROUP BY 1, 2), n AS (SELECT ticker, date, min(close) AS close FROM fx_prices WHERE date >= DATE '1996-06-01' GROUP BY 1, 2) SELECT ticker, date, coalesce(n.close, o.close) AS close FROM o FULL JOIN n USING (ticker, date)", "fx_prices")
def _(p):
    old = p.where("date < DATE '1997-01-01' OR ticker >= 'TH'").groupBy("ticker", "date").agg(F.max("close").alias("close"))
    return R.upsert_last_wins(old, p.where("date >= DATE '1996-06-01'").groupBy("ticker", "date").agg(F.min("close").alias("close")), ["ticker", "date"])


@_query("t06_retire_removed_documents", f"""SELECT doc_id, '{{"source_row_id":"' || source_row_id || '","ticker":"' || ticker || '"}}' AS row_json, 'removed_from_archive' AS reason FROM {D} WHERE order_key % 9 = 0""", D)
def _(d):
    return R.retire_removed_documents(d, d.where("order_key % 9 <> 0"))


@_query("g33_duplicate_identities", f"SELECT {_ID}, count(*) AS n FROM {D} GROUP BY ALL HAVING count(*) > 1", D)
def _(d):
    return R.duplicate_identities(d)


@_query("j36_missing_after_merge", f"SELECT DISTINCT doc_id, ticker FROM {D} WHERE source = 'form4' EXCEPT SELECT doc_id, ticker FROM {D} WHERE source <> 'form4'", D)
def _(d):
    return R.missing_after_merge(d.where("source = 'form4'"), d.where("source <> 'form4'"), ["doc_id", "ticker"])


@_query("j38_drop_superseded", f"SELECT doc_id, source_row_id, part_key FROM {D} WHERE source_record_id NOT IN (SELECT concat('D', order_key + 1) FROM {D} WHERE order_key % 13 = 0)", D)
def _(d):
    return R.drop_superseded(d.withColumn("amends", F.when(F.col("order_key") % 13 == 0, F.concat(F.lit("D"), F.col("order_key") + 1))), "source_record_id", "amends").select("doc_id", "source_row_id", "part_key")


@_query("k06_violation_preview", f"SELECT source, doc_id, source_row_id, part_key, supp_key, total, place FROM (SELECT *, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id, source_row_id, part_key, supp_key) AS place FROM {D} WHERE transaction_date > disclosure_date) WHERE place <= 25", D)
def _(d):
    return R.violation_preview(d.where("transaction_date > disclosure_date"), "source", ["doc_id", "source_row_id", "part_key", "supp_key"]).select("source", "doc_id", "source_row_id", "part_key", "supp_key", "total", "place")


_POOL = f"""WITH per AS (SELECT member, count(*) AS n, avg(alpha) AS mean, var_pop(alpha) AS v, min(alpha) AS lo, max(alpha) AS hi FROM {O} GROUP BY member),
one AS (SELECT sum(n) AS rows, count(*) AS groups, avg(mean) AS center, sum(v * n) AS ss, var_samp(mean) AS spread, avg(1.0 / n) AS inv FROM per),
w AS (SELECT center, ss / (rows - groups) AS within, greatest(spread - ss / (rows - groups) * inv, 1e-25) AS between FROM one),
p AS (SELECT member, n, mean, within / (n * between + within) AS shrinkage, center, between FROM per, w)"""


@_query("g08_partial_pooling", _POOL.replace(" within", " win").replace("between", "btw").replace("AS within", "AS win").replace(" within ", " win ") + " SELECT member, n, round(mean, 8) AS mean, round(shrinkage, 8) AS shrinkage, round((1 - shrinkage) * mean + shrinkage * center, 8) AS posterior_mean, round(sqrt(shrinkage * btw), 8) AS posterior_sd FROM p".replace("within", "win"), O)
def _(o):
    p = T.partial_pooling(o, "member", "alpha")
    return p.select("member", "n", *(F.round(c, 8).alias(c) for c in ("mean", "shrinkage", "posterior_mean", "posterior_sd")))


@_query("g07_member_ranking", f"SELECT member, count(*) AS episodes, avg(alpha) AS mean_alpha, avg((alpha > 0)::INT) AS positive_rate FROM {O} GROUP BY member", O)
def _(o):
    return T.member_ranking(o)


@_query("w06_score_quantiles", f"SELECT tx_id, as_of, score, CASE WHEN n = 1 THEN 5 WHEN tie = n THEN 3 ELSE least(5, ceil((r + (tie - 1) / 2.0::DOUBLE) / n * 5))::INT END AS quantile FROM (SELECT *, count(*) OVER (PARTITION BY as_of) AS n, count(*) OVER (PARTITION BY as_of, score) AS tie, rank() OVER (PARTITION BY as_of ORDER BY score) AS r FROM {O})", O)
def _(o):
    return T.score_quantiles(o, "as_of", "score").select("tx_id", "as_of", "score", "quantile")


@_query("g22_welch", f"SELECT count(*) FILTER (WHERE treated = 1) AS n1, count(*) FILTER (WHERE treated = 0) AS n0, avg(alpha) FILTER (WHERE treated = 1) AS mean1, avg(alpha) FILTER (WHERE treated = 0) AS mean0, round((avg(alpha) FILTER (WHERE treated = 1) - avg(alpha) FILTER (WHERE treated = 0)) / sqrt(var_samp(alpha) FILTER (WHERE treated = 1) / count(*) FILTER (WHERE treated = 1) + var_samp(alpha) FILTER (WHERE treated = 0) / count(*) FILTER (WHERE treated = 0)), 8) AS welch_t FROM {O}", O)
def _(o):
    return T.welch(o, F.col("treated"), "alpha").withColumn("welch_t", F.round("welch_t", 8))


@_query(
    "g23_clustered_t",
    f"""WITH b AS (SELECT avg(alpha) FILTER (WHERE treated = 0) AS b0, avg(alpha) FILTER (WHERE treated = 1) AS m1, count(*) AS n, sum(treated) AS n1 FROM {O}),
r AS (SELECT as_of, treated, alpha - CASE WHEN treated = 1 THEN m1 ELSE b0 END AS e FROM {O}, b),
u AS (SELECT as_of, sum(e) AS u0, sum(e * treated) AS u1 FROM r GROUP BY as_of),
m AS (SELECT count(*) AS c, sum(pow(-u0 / (n - n1) + u1 * n / (n1 * (n - n1)), 2)) AS v FROM u, b)
SELECT n AS rows, c AS clusters, round(m1 - b0, 8) AS beta, round((m1 - b0) / sqrt(v * c / (c - 1) * (n - 1) / (n - 2)), 6) AS clustered_t FROM b, m""",
    O,
)
def _(o):
    return T.clustered_t(o, "treated", "alpha", "as_of").select("rows", "clusters", F.round("beta", 8).alias("beta"), F.round("clustered_t", 6).alias("clustered_t"))


@_query("g24_cluster_mean_stats", f"WITH c AS (SELECT treated, as_of, sum(alpha) AS s, count(*) AS n FROM {O} GROUP BY 1, 2) SELECT treated, round(sum(s) / sum(n), 8) AS pooled_mean, round(avg(s / n), 8) AS cluster_mean, count(*) AS clusters, round(avg(s / n) / (stddev_samp(s / n) / sqrt(count(*))), 6) AS t FROM c GROUP BY treated", O)
def _(o):
    c = T.cluster_mean_stats(o, "treated", "as_of", "alpha")
    return c.select("treated", F.round("pooled_mean", 8).alias("pooled_mean"), F.round("cluster_mean", 8).alias("cluster_mean"), "clusters", F.round("t", 6).alias("t"))


_TIMES = "(" + " + ".join(f"(u >= {p:.8f}::DOUBLE)::INT" for p in T.POISSON) + ")"
_DRAW = "('0x' || left(md5('1|' || rep || '|' || as_of), 8))::BIGINT / 4294967296.0::DOUBLE AS u"


@_query("g25_cluster_bootstrap", f"""WITH c AS (SELECT as_of, avg(alpha) AS m FROM {O} GROUP BY 1), d AS (SELECT m, rep, {_DRAW} FROM c CROSS JOIN (SELECT unnest(range(1, 201)) AS rep)), p AS (SELECT rep, sum({_TIMES} * m) / sum({_TIMES}) AS m FROM d GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high, count(*) AS reps FROM p""", O)
def _(o):
    return T.cluster_bootstrap(o, "as_of", "alpha").select(F.round("low", 8).alias("low"), F.round("high", 8).alias("high"), "reps")


@_query(
    "g26_cohort_summary",
    f"""WITH o AS (SELECT as_of, score >= 15 AS ranked, CASE WHEN tx_id % 29 <> 0 THEN tx_id % 4 <> 0 END AS eligible, CASE WHEN tx_id % 31 <> 0 THEN 'Q' || (floor(score / 5) + 1)::INT END AS q, CASE WHEN tx_id % 17 <> 0 THEN alpha END AS excess FROM {O}),
g AS (SELECT as_of, excess, 'group_mean' AS metric, 'ranked' AS group_a, '' AS group_b FROM o WHERE ranked UNION ALL SELECT as_of, excess, 'group_mean', 'eligible_not_ranked', '' FROM o WHERE NOT ranked AND eligible UNION ALL SELECT as_of, excess, 'group_mean', 'ineligible', '' FROM o WHERE NOT eligible
 UNION ALL SELECT as_of, excess, 'score_quintile_mean', q, '' FROM o WHERE q IS NOT NULL UNION ALL SELECT as_of, excess, 'primary_top_quintile_vs_zero', q, 'zero' FROM o WHERE q = 'Q5'),
c AS (SELECT metric, group_a, group_b, as_of, avg(excess) AS m, sum(excess) AS s, count(*) AS n, NULL::DOUBLE AS s2, NULL::BIGINT AS n2 FROM g WHERE excess IS NOT NULL GROUP BY ALL),
x AS (SELECT * FROM c UNION ALL SELECT 'ranked_minus_baseline', 'ranked', b.group_a, as_of, a.m - b.m, a.s, a.n, b.s, b.n FROM (SELECT * FROM c WHERE group_a = 'ranked') a FULL JOIN (SELECT * FROM c WHERE group_a IN ('eligible_not_ranked', 'ineligible')) b USING (as_of) WHERE b.group_a IS NOT NULL
 UNION ALL SELECT 'ranked_minus_baseline', 'ranked', k.name, a.as_of, NULL, a.s, a.n, NULL, NULL FROM c a CROSS JOIN (SELECT unnest(['eligible_not_ranked', 'ineligible']) AS name) k WHERE a.group_a = 'ranked' AND NOT EXISTS (SELECT 1 FROM c b WHERE b.group_a = k.name AND b.as_of = a.as_of)),
st AS (SELECT metric, group_a, group_b, sum(n)::BIGINT AS n_ticker_dates, count(m) AS clusters, sum(s) / sum(n) - coalesce(sum(s2) / sum(n2), 0) AS mean_pooled, avg(m) AS mean_cluster, avg(m) / (stddev_samp(m) / sqrt(count(m))) AS t FROM x GROUP BY 1, 2, 3),
d AS (SELECT metric, group_a, group_b, m, rep, {_DRAW} FROM x CROSS JOIN (SELECT unnest(range(1, 201)) AS rep) WHERE m IS NOT NULL), p AS (SELECT metric, group_a, group_b, rep, sum({_TIMES} * m) / sum({_TIMES}) AS m FROM d GROUP BY 1, 2, 3, 4),
ci AS (SELECT metric, group_a, group_b, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM p GROUP BY 1, 2, 3)
SELECT metric, group_a, group_b, n_ticker_dates, clusters, round(mean_pooled, 7) AS mean_pooled, round(mean_cluster, 7) AS mean_cluster, round(t, 5) AS t, round(low, 7) AS low, round(high, 7) AS high, CASE WHEN metric LIKE 'primary%' THEN CASE WHEN clusters < 2 THEN 'NOT VALIDATABLE' WHEN mean_cluster > 0 AND low > 0 THEN 'PASS' ELSE 'NOT VALIDATED' END END AS verdict FROM st LEFT JOIN ci USING (metric, group_a, group_b)""",
    O,
)
def _(o):
    kept = lambda n, c: F.when(F.col("tx_id") % n != 0, c)
    panel = o.select("as_of", (F.col("score") >= 15).alias("ranked"), kept(29, F.col("tx_id") % 4 != 0).alias("entry_eligible"), kept(31, F.concat(F.lit("Q"), (F.floor(F.col("score") / 5) + 1).cast("string"))).alias("score_quintile"), kept(17, F.col("alpha")).alias("excess"))
    s = T.cohort_summary(panel)
    return s.withColumns({**{c: F.round(c, 7) for c in ("mean_pooled", "mean_cluster", "low", "high")}, "t": F.round("t", 5)})


@_query("g30_within_actor_demean", f"SELECT tx_id, round(alpha - am, 8) AS within, round(avg(am) OVER (PARTITION BY as_of), 8) AS cohort_mean FROM (SELECT *, avg(alpha) OVER (PARTITION BY member) AS am FROM {O})", O)
def _(o):
    return T.within_actor_demean(o, "member", "as_of", "alpha").select("tx_id", F.round("within", 8).alias("within"), F.round("cohort_mean", 8).alias("cohort_mean"))


@_query("g20_breadth_by_actor", f"SELECT member, count(DISTINCT ticker) AS breadth FROM {D} WHERE disclosure_date < DATE '1998-06-01' GROUP BY member", D)
def _(d):
    return T.breadth_by_actor(d, F.lit("1998-06-01").cast("date"))


@_query("g21_skill_labels", f"SELECT member, count(alpha) AS n, avg(alpha) AS mean, avg(alpha) > 0.5 AS skilled FROM {O} GROUP BY member HAVING count(alpha) >= 5", O)
def _(o):
    return T.skill_labels(o, 5, 0.5)


@_query("g06_skill_table", f"SELECT member, count(*) AS n, count(*) FILTER (WHERE alpha > 0) AS hits, avg(alpha) AS mean_excess FROM {O} GROUP BY member", O)
def _(o):
    return T.skill_table(o)


@_query("g52_actor_weights", f"WITH s AS (SELECT member, count(*) AS n, count(*) FILTER (WHERE alpha > 0) AS hits FROM {O} WHERE as_of < DATE '1996-06-01' GROUP BY member) SELECT DISTINCT d.member, (coalesce(hits, 0) + 0.46::DOUBLE * 20.0::DOUBLE) / (coalesce(n, 0) + 20.0::DOUBLE) AS weight FROM {O} d LEFT JOIN s ON s.member = d.member", O)
def _(o):
    return T.actor_weights(o.select("member").distinct(), T.skill_table(o.where("as_of < DATE '1996-06-01'")))


@_query("g28_drop_report", f"WITH r AS (SELECT source, ticker, unnest(string_split(CASE part_key % 4 WHEN 0 THEN 'late,small' WHEN 1 THEN 'small' WHEN 2 THEN '' ELSE 'late' END, ',')) AS reason FROM {D}) SELECT source, reason, count(*) AS rows, count(DISTINCT ticker) AS tickers FROM r WHERE reason <> '' GROUP BY 1, 2", D)
def _(d):
    reasons = F.element_at(F.array(*(F.lit(x) for x in ("late,small", "small", "", "late"))), (F.col("part_key") % 4 + 1).cast("int"))
    return T.drop_report(d.withColumn("reasons", reasons), ["source"], "reasons")


@_query("g29_tolerance_sweep", f"WITH e AS (SELECT *, unnest([2.0, 8.0, 15.0])::DOUBLE AS tolerance FROM {O}) SELECT tolerance, count(*) FILTER (WHERE score <= tolerance) AS n1, count(*) FILTER (WHERE score > tolerance) AS n0, avg(alpha) FILTER (WHERE score <= tolerance) AS mean1, avg(alpha) FILTER (WHERE score > tolerance) AS mean0, round((avg(alpha) FILTER (WHERE score <= tolerance) - avg(alpha) FILTER (WHERE score > tolerance)) / sqrt(var_samp(alpha) FILTER (WHERE score <= tolerance) / count(*) FILTER (WHERE score <= tolerance) + var_samp(alpha) FILTER (WHERE score > tolerance) / count(*) FILTER (WHERE score > tolerance)), 8) AS welch_t, avg((alpha > 0)::INT) FILTER (WHERE score <= tolerance) AS hit_rate FROM e GROUP BY tolerance", O)
def _(o):
    return T.tolerance_sweep(o, "score", "alpha", [2.0, 8.0, 15.0]).withColumn("welch_t", F.round("welch_t", 8))


@_query("g31_pooled_error_rate", f"WITH n AS (SELECT extract(year FROM as_of) AS y, count(*) AS p FROM {O} GROUP BY 1), e AS (SELECT extract(year FROM as_of) AS y, count(*) AS c, count(*) FILTER (WHERE alpha > 10) AS x FROM {O} WHERE part_mod = 0 GROUP BY 1) SELECT round(sum(p * x / c::DOUBLE) / sum(p), 10) AS rate, sum(c)::BIGINT AS checked FROM n JOIN e USING (y)".replace("part_mod = 0", "tx_id % 3 = 0"), O)
def _(o):
    y = o.withColumn("y", F.year("as_of"))
    return T.pooled_error_rate(y, y.where("tx_id % 3 = 0").withColumn("error", (F.col("alpha") > 10).cast("int")), "y").withColumn("rate", F.round("rate", 10))


@_query("g09_sector_leaders", f"WITH s AS (SELECT DISTINCT ticker, substr(ticker, 3, 1) || CASE WHEN ticker < 'TM' THEN '1' ELSE '2' END AS sector FROM {O}), p AS (SELECT sector, member, count(*) AS n, avg(alpha) AS mean_alpha FROM {O} JOIN s USING (ticker) GROUP BY 1, 2), q AS (SELECT *, sum(n) OVER (PARTITION BY sector)::BIGINT AS purchases, row_number() OVER (PARTITION BY sector ORDER BY mean_alpha DESC, member) AS k FROM p) SELECT sector, member, n, mean_alpha, purchases FROM q WHERE k = 1 AND purchases >= 3", O)
def _(o):
    sectors = o.select("ticker", F.concat(F.substring("ticker", 3, 1), F.when(F.col("ticker") < "TM", "1").otherwise("2")).alias("sector")).distinct()
    return T.sector_leaders(o, sectors)


@_query("j22_attach_sector", f"SELECT tx_id, o.ticker, sector FROM {O} o LEFT JOIN (SELECT DISTINCT ticker, substr(ticker, 3, 1) || CASE WHEN ticker < 'TM' THEN '1' ELSE '2' END AS sector FROM {O} WHERE ticker > 'TC') s ON s.ticker = o.ticker", O)
def _(o):
    sectors = o.where("ticker > 'TC'").select("ticker", F.concat(F.substring("ticker", 3, 1), F.when(F.col("ticker") < "TM", "1").otherwise("2")).alias("sector")).distinct()
    return T.attach_sector(o.select("tx_id", "ticker"), sectors)


@_query("s13_read_transactions", f"SELECT doc_id, source_row_id, part_key, supp_key FROM {D} WHERE extract(year FROM disclosure_date) = 1997 AND source IN ('senate_efd', 'form4') AND disclosure_date BETWEEN DATE '1997-02-01' AND DATE '1998-02-01'", D)
def _(d):
    return R.read_transactions(d, 1997, ("1997-02-01", "1998-02-01"), ["senate_efd", "form4"]).select("doc_id", "source_row_id", "part_key", "supp_key")


@_query("s14_read_skill_history", f"SELECT doc_id, source_row_id, part_key, supp_key FROM {D} WHERE disclosure_date < DATE '1998-06-01' AND (source, member) IN (SELECT source, member FROM {D} WHERE disclosure_date = DATE '1998-06-01')", D)
def _(d):
    day = F.lit("1998-06-01").cast("date")
    return R.read_skill_history(d, d.where(F.col("disclosure_date") == day), day).select("doc_id", "source_row_id", "part_key", "supp_key")


_INDEX = f"(SELECT doc_id, min(member) AS member, min(disclosure_date) AS filed, max(order_key) AS o FROM {D} GROUP BY doc_id)"


@_query("t04_replace_archive", f"WITH a AS (SELECT doc_id, member, filed FROM {_INDEX} WHERE o % 5 <> 0), b AS (SELECT doc_id, CASE WHEN o % 7 = 0 THEN 'RENAMED' ELSE member END AS member, filed FROM {_INDEX} WHERE o % 3 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'inserted' WHEN a.member = b.member THEN 'same' ELSE 'updated' END AS change, b.member, b.filed FROM a FULL JOIN b ON a.doc_id = b.doc_id", D)
def _(d):
    i = d.groupBy("doc_id").agg(F.min("member").alias("member"), F.min("disclosure_date").alias("filed"), F.max("order_key").alias("o"))
    new = i.where("o % 3 <> 0").withColumn("member", F.when(F.col("o") % 7 == 0, "RENAMED").otherwise(F.col("member"))).drop("o")
    return R.replace_archive(i.where("o % 5 <> 0").drop("o"), new)


@_query("t10_served_state", f"WITH t AS (SELECT ticker, max(part_key) AS k, max(supp_key) AS s FROM {D} GROUP BY ticker), a AS (SELECT ticker, 'g' || k AS served, true AS comparable FROM t WHERE k % 4 <> 0), b AS (SELECT ticker, 'h' || s AS generation, s % 2 = 0 AS ok FROM t WHERE s % 5 <> 0) SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN ok THEN generation ELSE coalesce(served, generation) END AS served, coalesce(ok, comparable) AS comparable, served IS NULL AS inserted FROM a FULL JOIN b ON a.ticker = b.ticker", D)
def _(d):
    t = d.groupBy("ticker").agg(F.max("part_key").alias("k"), F.max("supp_key").alias("s"))
    state = t.where("k % 4 <> 0").select("ticker", F.concat(F.lit("g"), "k").alias("served"), F.lit(True).alias("comparable"))
    return R.served_state(state, t.where("s % 5 <> 0").select("ticker", F.concat(F.lit("h"), "s").alias("generation"), (F.col("s") % 2 == 0).alias("comparable")))
