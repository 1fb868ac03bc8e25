"""Queries of the identity operators over names and descriptions made from the tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identities as I
from ..sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
D = "fx_disclosures"


def _query(name: str, sql: str, *views: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


# A name of first name, middle name or none, and one of many surnames; the same expressions run in both engines.
_FIRST = "CASE part_key % 5 WHEN 0 THEN 'CHUCK' WHEN 1 THEN 'CHARLES' WHEN 2 THEN 'BILL' WHEN 3 THEN 'WILLIAM' ELSE 'DICK' END"
_MIDDLE = "CASE supp_key % 7 WHEN 0 THEN 'J' WHEN 1 THEN 'JOHN' WHEN 2 THEN 'JAMES' ELSE '' END"
_LAST = "concat('N', order_key % 400)"
_NAME = f"concat({_FIRST}, CASE WHEN ({_MIDDLE}) = '' THEN ' ' ELSE concat(' ', {_MIDDLE}, ' ') END, {_LAST})"
_PEOPLE = f"""n AS (SELECT DISTINCT {_NAME} AS key, {_FIRST} AS f, {_MIDDLE} AS m, {_LAST} AS l FROM {D}),
j AS (SELECT a.key AS a, b.key AS b FROM n a JOIN n b ON a.l = b.l AND a.key <> b.key AND (a.f = b.f OR {{a.f, b.f}} = 1) AND (a.m = '' OR b.m = '' OR a.m = b.m OR (a.m = 'J' AND b.m LIKE 'J%') OR (b.m = 'J' AND a.m LIKE 'J%'))),
x AS (SELECT DISTINCT p.a AS key FROM j p JOIN j q ON p.a = q.a AND p.b < q.b WHERE NOT EXISTS (SELECT 1 FROM j r WHERE r.a = p.b AND r.b = q.b)),
g AS (SELECT n.key, CASE WHEN n.key IN (SELECT key FROM x) THEN '' ELSE least(n.key, coalesce((SELECT min(j.b) FROM j WHERE j.a = n.key AND j.b NOT IN (SELECT key FROM x)), n.key)) END AS identity FROM n)""".replace(
    "{a.f, b.f} = 1", "(a.f IN ('CHUCK', 'CHARLES') AND b.f IN ('CHUCK', 'CHARLES')) OR (a.f IN ('BILL', 'WILLIAM') AND b.f IN ('BILL', 'WILLIAM'))"
)


@_query("j20_member_identity_groups", f"WITH {_PEOPLE} SELECT key, identity FROM g", D)
def _(d):
    return I.member_identity_groups(d.select(F.expr(_NAME).alias("key")))


# Actors in their order: open positions by name, then as first seen; officers never meet others.
_KIND = "CASE WHEN supp_key % 13 = 0 THEN 'officer:' ELSE 'congress:' END"
_SEEN = "concat(lpad(CAST(CAST(order_key AS bigint) AS varchar(9)), 9, '0'), source_row_id, lpad(CAST(CAST(part_key AS bigint) AS varchar(9)), 9, '0'), lpad(CAST(CAST(supp_key AS bigint) AS varchar(9)), 9, '0'))"


@_query(
    "j21_coalesce_actors",
    f"""WITH RECURSIVE ac AS MATERIALIZED (SELECT concat({_KIND}, {_NAME}) AS actor, {_KIND} AS kind, {_FIRST} AS f, {_MIDDLE} AS m, {_LAST} AS l, min({_SEEN}) AS seen, bool_or(part_key % 11 = 0) AS open_ FROM {D} GROUP BY 1, 2, 3, 4, 5),
od AS MATERIALIZED (SELECT *, CASE WHEN kind = 'congress:' THEN l ELSE actor END AS grp, CASE f WHEN 'CHUCK' THEN 'CHARLES' WHEN 'BILL' THEN 'WILLIAM' ELSE f END AS ff, row_number() OVER (PARTITION BY CASE WHEN kind = 'congress:' THEN l ELSE actor END ORDER BY NOT open_, CASE WHEN open_ THEN actor END, CASE WHEN NOT open_ THEN seen END) AS n FROM ac),
st AS (
  SELECT grp, 0::BIGINT AS n, list({{'a': actor, 'ff': ff, 'm': m}} ORDER BY actor) FILTER (WHERE open_) AS reps, NULL::VARCHAR AS actor, NULL::VARCHAR AS rep FROM od GROUP BY grp
  UNION ALL
  SELECT grp, n, CASE WHEN hit IS NULL THEN list_append(coalesce(reps, []), {{'a': actor, 'ff': ff, 'm': m}}) ELSE reps END, actor, CASE WHEN open_ THEN actor ELSE coalesce(hit, actor) END
  FROM (SELECT od.grp, od.n, od.actor, od.ff, od.m, od.open_, reps, list_filter(coalesce(reps, []), lambda r: r.ff = od.ff AND (r.m = '' OR od.m = '' OR r.m = od.m))[1].a AS hit FROM st JOIN od ON od.grp = st.grp AND od.n = st.n + 1)),
mp AS MATERIALIZED (SELECT actor, rep FROM st WHERE actor IS NOT NULL), sp AS (SELECT rep, arg_max(lower(substr(actor, strpos(actor, ':') + 1)), (len(string_split(actor, ' ')), length(substr(actor, strpos(actor, ':') + 1)), lower(substr(actor, strpos(actor, ':') + 1)))) AS display FROM mp GROUP BY 1)
SELECT doc_id, source_row_id, part_key, supp_key, concat({_KIND}, {_NAME}) AS actor, rep AS identity, display FROM {D} JOIN mp ON mp.actor = concat({_KIND}, {_NAME}) JOIN sp USING (rep)""",
    D,
)
def _(d):
    events = d.select("doc_id", "source_row_id", "part_key", "supp_key", F.expr(f"concat({_KIND}, {_NAME})").alias("actor"), F.expr(_SEEN).alias("seen"), F.expr(f"lower({_NAME})").alias("spelling"))
    held = d.where("part_key % 11 = 0").select(F.expr(f"concat({_KIND}, {_NAME})").alias("actor"))
    return I.coalesce_actors(events, held, "actor", "seen", "spelling").select("doc_id", "source_row_id", "part_key", "supp_key", "actor", "identity", "display")


# Companies: every part name, and every noun of one; a GEAR is two companies.
_COMPANIES = f"SELECT upper(name) AS name, concat('S', min(part_key)) AS symbol FROM (SELECT regexp_replace(asset_description, ' (\\[..\\]|Treasury.*|mutual fund)$', '') AS name, part_key FROM {D}) GROUP BY 1 UNION ALL SELECT DISTINCT upper(split_part(asset_description, ' ', 2)), CASE WHEN split_part(asset_description, ' ', 2) = 'gear' THEN concat('N', part_key % 2) ELSE 'N9' END FROM {D}"
_TEXT = "CASE supp_key % 11 WHEN 7 THEN concat(split_part(asset_description, ' ', 2), ' [ACCOUNT: Cash Fund ', line_number, ']') WHEN 8 THEN concat('Zoetis Inc. CMN Class A (custodian= Bond ', line_number, ')') WHEN 9 THEN concat('Johnson & Johnson Holdings Limited account: ', line_number) WHEN 10 THEN CASE WHEN line_number % 2 = 0 THEN 'Banco NV' ELSE 'Amazon and Visa Group' END WHEN 0 THEN asset_description WHEN 1 THEN concat('shares of ', split_part(asset_description, ' ', 2), ' Corp.') WHEN 2 THEN concat(split_part(asset_description, ' ', 2), ' and small ring') WHEN 3 THEN concat(substr(asset_description, 1, 4), ' ', substr(split_part(asset_description, ' ', 2), 1, 4)) WHEN 4 THEN 'nothing known' WHEN 5 THEN concat(split_part(asset_description, ' ', 1), ' note') ELSE '' END"


def _companies(d: DataFrame) -> DataFrame:
    name = F.upper(F.regexp_replace("asset_description", " (\\[..\\]|Treasury.*|mutual fund)$", ""))
    noun = F.split_part("asset_description", F.lit(" "), F.lit(2))
    whole = d.groupBy(name.alias("name")).agg(F.concat(F.lit("S"), F.min("part_key")).alias("symbol"))
    return whole.union(d.select(F.upper(noun), F.when(noun == "gear", F.concat(F.lit("N"), F.col("part_key") % 2)).otherwise("N9")).distinct())


_TAIL = "(\\s+(CMN|COMMON STOCK|CLASS [ABC]|INC|INCORPORATED|CORP|CORPORATION|COMPANY|COS|LLC|LTD|LIMITED|PLC|HOLDINGS|HOLDING|GROUP|LP|LLP|PA|NA))+$"
_REMARK = "\\s*\\[\\s*(?:ACCOUNT|CUSTODIAN)\\s*[:=][^\\]]*\\]|\\s*\\(\\s*(?:ACCOUNT|CUSTODIAN)\\s*[:=][^)]*\\)|(?:^|\\s+)(?:ACCOUNT|CUSTODIAN)\\s*[:=].*$"
_ALIASES = ", ".join(f"('{a.replace('&', 'AND')}', '{t}')" for a, t in I.ALIASES.items()).replace("'CTS CORP'", "'CTS'").replace("'BOOKING HOLDINGS'", "'BOOKING'").replace("'VISHAY PRECISION GROUP'", "'VISHAY PRECISION'").replace("'UNITEDHEALTH GROUP'", "'UNITEDHEALTH'")
_MATCH = f"""c0 AS ({_COMPANIES}), c AS (SELECT name, symbol, false AS alias FROM c0 UNION ALL SELECT *, true FROM (VALUES {_ALIASES})), tx AS (SELECT DISTINCT {_TEXT} AS text FROM {D}),
t AS (SELECT text, norm, string_split(norm, ' ') AS w FROM (SELECT text, trim(regexp_replace(trim(regexp_replace(replace(upper(regexp_replace(text, '{_REMARK}', '', 'gi')), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), '{_TAIL}', '')) AS norm FROM tx)
 WHERE norm <> '' AND NOT regexp_matches(norm, '\\b(TREASURY|T BILL|T NOTE|SWEEP|MONEY MARKET|MUTUAL FUND|INDEX FUND|INVESTMENT FUND|ETF|ETN|FUND|CASH|BOND|NOTE|MTN|FD)S?\\b')),
o AS (SELECT text, w, unnest(generate_series(1, len(w))) AS i FROM t), sp AS (SELECT DISTINCT text, i, i + len(string_split(name, ' ')) AS e, symbol FROM o JOIN c ON array_to_string(w[i : i + len(string_split(name, ' ')) - 1], ' ') = name),
u AS (SELECT text, count(DISTINCT symbol) AS n, min(symbol) AS symbol FROM sp WHERE NOT EXISTS (SELECT 1 FROM sp z WHERE z.text = sp.text AND z.i <= sp.i AND sp.e <= z.e AND (z.i <> sp.i OR z.e <> sp.e)) GROUP BY 1),
ab AS (SELECT text, count(DISTINCT symbol) AS n, min(symbol) AS symbol FROM t JOIN c ON NOT alias AND len(w) = len(string_split(name, ' ')) AND list_bool_and(list_transform(generate_series(1, len(w)), lambda k: length(w[k]) >= 4 AND starts_with(string_split(name, ' ')[k], w[k]))) WHERE text NOT IN (SELECT text FROM u) GROUP BY 1),
mt AS (SELECT text, CASE WHEN u.n = 1 THEN u.symbol WHEN ab.n = 1 THEN ab.symbol END AS symbol FROM tx LEFT JOIN u USING (text) LEFT JOIN ab USING (text))"""


@_query("j19_match_company_names", f"WITH {_MATCH} SELECT text, symbol FROM mt", D)
def _(d):
    return I.match_company_names(d.select(F.expr(_TEXT).alias("text")), _companies(d))


@_query("t08_backfill_tickers", f"WITH {_MATCH}, r AS (SELECT doc_id, source_row_id, part_key, supp_key, CASE WHEN part_key % 3 = 0 THEN ticker END AS ticker, {_TEXT} AS text FROM {D}) SELECT doc_id, source_row_id, part_key, supp_key, coalesce(ticker, symbol) AS ticker, CASE WHEN ticker IS NULL AND symbol IS NOT NULL THEN 'resolved_asset_name' ELSE 'official' END AS ticker_origin FROM r JOIN mt USING (text)", D)
def _(d):
    rows = d.select("doc_id", "source_row_id", "part_key", "supp_key", F.when(F.col("part_key") % 3 == 0, F.col("ticker")).alias("ticker"), F.expr(_TEXT).alias("asset_description"), F.lit("official").alias("ticker_origin"))
    return I.backfill_tickers(rows, _companies(d)).select("doc_id", "source_row_id", "part_key", "supp_key", "ticker", "ticker_origin")


_WRONG = "CASE part_key % 6 WHEN 0 THEN concat('ALPHABET ', substr(ticker, 2, 1)) WHEN 1 THEN concat('Alphabet Class A', line_number) WHEN 2 THEN CASE WHEN line_number % 2 = 0 THEN 'MONEY MARKET SWEEP' ELSE 'ALPHABET Z' END WHEN 3 THEN 'UNKNOWN COMPANY' WHEN 4 THEN 'GOOG' ELSE ticker END"
# Keys that rows share, at times null: with them rows repeat one another.
_KEYED = f"SELECT doc_id, CASE WHEN line_number % 5 <> 0 THEN member END AS member, order_key % 4 AS lot, transaction_type, part_key, supp_key, {_WRONG} AS ticker FROM {D}"


@_query(
    "t09_clean_symbols",
    f"""WITH r AS MATERIALIZED ({_KEYED}), m AS MATERIALIZED (SELECT *, CASE WHEN regexp_full_match(ticker, '[A-Z]{{1,5}}([.][AB])?') OR length(ticker) <= 5 THEN NULL WHEN upper(ticker) LIKE 'ALPHABET CLASS A%' THEN 'GOOGL' WHEN upper(ticker) LIKE 'ALPHABET%' THEN 'GOOG' END AS to_ FROM r)
SELECT doc_id, part_key, supp_key, CASE WHEN to_ IS NOT NULL THEN to_ WHEN length(ticker) > 5 AND upper(ticker) LIKE '%MONEY%' THEN NULL ELSE ticker END AS ticker FROM m
WHERE to_ IS NULL OR NOT EXISTS (SELECT 1 FROM m z WHERE z.member = m.member AND z.lot = m.lot AND z.transaction_type = m.transaction_type AND (z.to_ IS NULL AND z.ticker = m.to_ OR z.to_ = m.to_ AND z.ticker < m.ticker))""",
    D,
)
def _(d):
    names = d.sparkSession.createDataFrame([("ALPHABET", "GOOG"), ("ALPHABET CLASS A", "GOOGL")], "name string, symbol string")
    null_at = F.when(F.col("line_number") % 5 != 0, F.col("member")).alias("member")
    rows = d.select("doc_id", null_at, (F.col("order_key") % 4).alias("lot"), "transaction_type", "part_key", "supp_key", F.expr(_WRONG).alias("ticker"))
    return I.clean_symbols(rows, names, ["member", "lot", "transaction_type"]).select("doc_id", "part_key", "supp_key", "ticker")
