"""Views that project the driver's tables onto disclosure data; the texts run in Spark and in DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _pick(key: str, values: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


_LOW = "p_partkey % 9 + 1, ',', lpad(cast(p_partkey * 37 % 1000 as string), 3, '0')"
_HIGH = "p_partkey % 80 + 11, ',', lpad(cast(p_partkey * 53 % 1000 as string), 3, '0')"
_CENTS = "lpad(cast(p_partkey % 100 as string), 2, '0')"
_SYMBOL = "substr('ABCDEFGHIJKLMNOPQRSTUVWXY', cast(p_partkey % 25 as int) + 1, 1), 'Q', substr('JKLMNVWXYZ', cast(p_partkey % 10 as int) + 1, 1)"
_SURNAME = "concat('Q', translate(cast(cast(p_partkey as int) as string), '0123456789', 'abcdefghij'))"
_SECURITY = """concat('T', substr('ABCDEFGHIJKLMNOPQRSTUVWXY', cast(p_partkey % 25 as int) + 1, 1), substr('XY', cast(p_partkey % 2 as int) + 1, 1), CASE WHEN p_partkey < 50 THEN '' ELSE cast(cast(floor(p_partkey / 50) as int) as string) END)"""
_LISTED = "CASE WHEN p_partkey < 50 THEN 0 ELSE p_partkey * 37 % 2600 END AS lo, CASE WHEN p_partkey < 50 THEN 5000 ELSE p_partkey * 37 % 2600 + 90 END AS hi"
_CLOSE = "CAST(20 + (p_partkey * 7) % 80 AS double) + CAST((k * (p_partkey % 13 + 3)) % 41 - 20 AS double) * CAST(0.25 AS double)"
_BENCH = "CAST(100 AS double) + CAST(k AS double) * CAST(0.03125 AS double) + CAST((k * 5) % 17 AS double) * CAST(0.125 AS double)"

VIEWS: dict[str, str] = {
    "fx_disclosures": """
SELECT concat('D', l_orderkey) AS doc_id, concat('D', l_orderkey) AS source_record_id, concat('R', l_linenumber) AS source_row_id,
 concat('g', l_linenumber % 2) AS ingestion_generation,
 CASE l_suppkey % 5 WHEN 0 THEN 'house_pdf' WHEN 1 THEN 'gemini_ocr' WHEN 2 THEN 'senate_efd' WHEN 3 THEN 'form4' ELSE '13f' END AS source,
 CASE WHEN l_suppkey % 5 = 2 THEN 'senate' ELSE 'house' END AS chamber,
 concat('MEMBER ', o_custkey % 97) AS member, concat('T', substr('ABCDEFGHIJKLMNOPQRSTUVWXY', cast(l_partkey % 25 as int) + 1, 1), substr('XY', cast(l_partkey % 2 as int) + 1, 1)) AS ticker,
 CAST(o_orderdate AS date) AS transaction_date,
 CAST(o_orderdate AS date) + CAST(l_suppkey % 60 - 5 AS int) AS disclosure_date,
 CASE l_returnflag WHEN 'A' THEN 'Purchase' WHEN 'R' THEN 'Sale' ELSE 'Exchange' END AS transaction_type,
 CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 'Sale (Full)' WHEN l_returnflag = 'R' THEN 'Sale (Partial)' END AS raw_transaction_subtype,
 CASE l_linenumber % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'SP' ELSE 'JT' END AS owner_code,
 l_extendedprice AS amount_midpoint, l_quantity AS quantity, l_partkey AS part_key, l_orderkey AS order_key, l_linenumber AS line_number, l_suppkey AS supp_key,
 concat(p_name, CASE l_linenumber WHEN 7 THEN ' [OP]' WHEN 6 THEN ' Treasury Bill [GS]' WHEN 5 THEN ' mutual fund' ELSE ' [ST]' END) AS asset_description
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_text": f"""
SELECT p_partkey AS row_key,
 {_pick("p_partkey", ["P", "S (partial)", "Sale (Full)", "Purchase", "E", "buy and sell", "Exchange", "sold", "x", "purchase (partial)", None])} AS type_text,
 {_pick("p_partkey", ["Self", "SPOUSE", "Joint account", "Dependent child", "JT", "", None, "other", " dc "])} AS owner_text,
 CASE p_partkey % 11 WHEN 0 THEN concat('$', {_LOW}, ' - $', {_HIGH}) WHEN 1 THEN concat('$', p_partkey % 9 + 1, ',001 - $', {_HIGH}) WHEN 2 THEN concat('$', {_LOW}, ' -') WHEN 3 THEN concat('$', p_partkey % 90 + 10, ',001') WHEN 4 THEN concat('$', {_HIGH}, '.', {_CENTS})
  WHEN 5 THEN concat('Over $', {_HIGH}, ',000') WHEN 6 THEN 'none' WHEN 7 THEN concat('$', {_LOW}, ',001 - $', {_HIGH}, ',000') WHEN 8 THEN '' WHEN 10 THEN concat('$', p_partkey % 90 + 10, ',', {_CENTS}) END AS amount_text,
 CASE p_partkey % 6 WHEN 0 THEN concat(p_partkey % 12 + 1, '/', p_partkey % 28 + 1, '/2024') WHEN 1 THEN concat(p_partkey % 12 + 1, '/', p_partkey % 31 + 1, '/', p_partkey % 90 + 10)
  WHEN 2 THEN concat('filed 2023-0', p_partkey % 9 + 1, '-1', p_partkey % 10) WHEN 3 THEN '13/45/2024' WHEN 4 THEN 'n/a' END AS date_text,
 concat(p_name, CASE p_partkey % 14 WHEN 1 THEN concat(' [OP] call option strike price $', p_partkey % 400 + 1, '.', {_CENTS}, ' exp ', p_partkey % 12 + 1, '/', p_partkey % 28 + 1, '/2024') WHEN 2 THEN concat(' (', {_SYMBOL}, ') [ST]') WHEN 6 THEN concat(' $', {_SYMBOL}, ' shares')
  WHEN 7 THEN concat(' stock put strike $', {_HIGH}, '.', {_CENTS}, ' exp ', p_partkey % 9 + 1, '/', p_partkey % 28 + 1, '/', p_partkey % 20 + 20) WHEN 8 THEN concat(' ', {_SYMBOL}, ': common') WHEN 9 THEN ' (SP) [CT]' ELSE {_pick("p_partkey", [" [ST]", None, None, " Treasury Bills", " mutual fund", " corporate bond", None, None, None, None, " [GS]", " simple agreement for future equity", " Inc. Common Stock", " Corp. Class A"])} END) AS asset_text,
 CASE p_partkey % 12 WHEN 0 THEN concat('Hon. Renée ', {_SURNAME}) WHEN 1 THEN concat('Dr. John ', {_SURNAME}, ' Jr.') WHEN 2 THEN concat('MICHAEL T. ', upper({_SURNAME})) WHEN 3 THEN concat('Neal Patrick ', {_SURNAME}, ' MD, FACS') WHEN 4 THEN concat('J. D. ', {_SURNAME}) WHEN 5 THEN 'N/A' WHEN 6 THEN ''
  WHEN 7 THEN concat('José E. ', {_SURNAME}) WHEN 8 THEN concat('Lee ', {_SURNAME}, ' Ph.D.') WHEN 9 THEN 'Unknown' WHEN 10 THEN concat('J.D. ', {_SURNAME}) ELSE concat('  mike   ', {_SURNAME}, ' ') END AS name_text,
 {_pick("p_partkey", [" aapl ", "BRK.B", "NaN", "none", "TOOLONG", "goog", "FUND", "b-c", "", "12AB", None])} AS ticker_text,
 {_pick("p_partkey", ["037833100", "037833101", "594918104", "38259P508", "1234", "88160R101", "G1151C101", "00000000X"])} AS cusip_text,
 CASE p_partkey % 5 WHEN 0 THEN concat('bought ', {_LOW}, ' shares @ $', p_partkey % 50 + 1, '.', {_CENTS}, ' today') WHEN 1 THEN concat(p_partkey % 900 + 1, ' shares @ $', p_partkey % 7 + 1) WHEN 2 THEN 'no lot' WHEN 3 THEN concat(p_partkey % 30, '.5 Shares at $', {_HIGH}, '.', {_CENTS}) ELSE concat({_HIGH}, ' share @ $ ', p_partkey % 90 + 1, '.5') END AS lot_text,
 {_pick("p_partkey", ["House_PDF v2", "gemini-2.0-flash OCR", "senate efd 3", "form4 xml", "13f infotable", "unknown engine"])} AS parser_text
FROM part""",
    # Weekdays from the first order to eleven months after the last; k counts days from a Sunday.
    "fx_sessions@spark": """
SELECT session_date, k FROM (SELECT d AS session_date, datediff(d, DATE '1995-01-01') AS k FROM (SELECT explode(sequence(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT CAST(min(o_orderdate) AS date) AS lo, date_add(CAST(max(o_orderdate) AS date), 333) AS hi FROM orders))) g WHERE k % 7 NOT IN (0, 6)""",
    "fx_sessions@duckdb": """
SELECT session_date, k FROM (SELECT d AS session_date, CAST(datediff('day', DATE '1995-01-01', d) AS int) AS k FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date) AS d FROM (SELECT CAST(min(o_orderdate) AS date) AS lo, CAST(max(o_orderdate) AS date) + 333 AS hi FROM orders))) g WHERE k % 7 NOT IN (0, 6)""",
    # Every part is a security: the first fifty are quoted all the time (disclosures name them), the others for a quarter.
    "fx_prices@spark": f"""
SELECT ticker, session_date AS date, {_CLOSE} AS close FROM (SELECT p_partkey, ticker, explode(sequence(lo, hi)) AS k FROM (SELECT p_partkey, {_SECURITY} AS ticker, {_LISTED} FROM part)) p JOIN fx_sessions USING (k) WHERE (k + p_partkey) % 37 <> 0
UNION ALL SELECT 'SPY', session_date, {_BENCH} FROM fx_sessions""",
    "fx_prices@duckdb": f"""
SELECT ticker, session_date AS date, {_CLOSE} AS close FROM (SELECT p_partkey, {_SECURITY} AS ticker, {_LISTED} FROM part) p JOIN fx_sessions ON k BETWEEN lo AND hi WHERE (k + p_partkey) % 37 <> 0
UNION ALL SELECT 'SPY', session_date, {_BENCH} FROM fx_sessions""",
    "fx_purchases": """
SELECT *, CAST(order_key * 10 + line_number AS bigint) * 1000000000 + part_key * 10000 + supp_key AS tx_id FROM fx_disclosures
WHERE transaction_type = 'Purchase' AND source IN ('house_pdf', 'gemini_ocr', 'senate_efd') AND transaction_date <= disclosure_date AND amount_midpoint >= 1001 AND asset_description LIKE '%[ST]'""",
    "fx_outcomes": """
SELECT tx_id, member, ticker, source, chamber, disclosure_date AS as_of, CAST((part_key * 31 + order_key * 17 + line_number * 7) % 2001 - 1000 AS double) / CAST(64 AS double) AS alpha,
 CASE WHEN (part_key + order_key) % 3 = 0 THEN 1 ELSE 0 END AS treated, CAST((part_key * 13 + order_key) % 23 AS double) AS score
FROM fx_purchases""",
    "fx_runs": """
SELECT doc_id, source, ingestion_generation, concat('a', max(order_key) % 1000) AS artifact, extract(year FROM min(disclosure_date)) AS archive_year,
 CASE max(order_key) % 7 WHEN 0 THEN 'invalid' WHEN 1 THEN 'failed' ELSE 'success' END AS status, count(*) + CASE WHEN max(order_key) % 11 = 0 THEN 1 ELSE 0 END AS stated_count,
 max(order_key) % 5 <> 0 AS promoted, max(disclosure_date) + CAST(max(line_number) AS int) AS parsed_at
FROM fx_disclosures GROUP BY doc_id, source, ingestion_generation""",
    # Filings of all sources: symbols that rules change or bar, officers' lots, amounts below the floor, unknown members.
    "fx_filings": """
SELECT source_record_id, source_row_id, ingestion_generation, source, CASE WHEN part_key % 29 <> 0 THEN member END AS member,
 CASE part_key % 41 WHEN 0 THEN 'FB' WHEN 1 THEN 'SP' WHEN 2 THEN 'CELG' WHEN 3 THEN 'BRK.B' WHEN 4 THEN NULL WHEN 5 THEN 'SPCX' ELSE ticker END AS ticker,
 transaction_date, disclosure_date, transaction_type, raw_transaction_subtype, owner_code, CAST(CASE WHEN part_key % 23 = 0 THEN 500 WHEN part_key % 31 = 0 THEN NULL ELSE amount_midpoint END AS double) AS amount_midpoint, quantity, part_key, order_key, line_number, supp_key,
 CASE WHEN source = 'form4' AND part_key % 3 <> 0 THEN concat('Common Stock ', CAST(part_key % 5 AS int), ',', lpad(CAST(CAST(line_number * 100 AS int) AS string), 3, '0'), ' shares @ $', CAST(part_key % 90 + 1 AS int)) ELSE asset_description END AS asset_description
FROM fx_disclosures""",
    "fx_reports": """
SELECT ingestion_generation, source_record_id, CAST(count(*) * 40 AS bigint) AS accepted_row_count FROM fx_disclosures WHERE source = 'senate_efd' GROUP BY ingestion_generation, source_record_id""",
    "fx_states": """
SELECT ticker, 'g1' AS generation, CASE WHEN substr(ticker, 2, 1) IN ('B', 'C') THEN 'unknown' ELSE 'comparable' END AS comparability, CASE WHEN substr(ticker, 2, 1) = 'C' THEN 'generations diverge' END AS reason
FROM (SELECT DISTINCT ticker FROM fx_prices WHERE ticker <> 'SPY' AND substr(ticker, 2, 1) <> 'A') t""",
    "fx_factors": """
SELECT ticker, generation, date, CASE generation WHEN 'g2' THEN CAST(9 AS double) ELSE CASE extract(day FROM date) WHEN 5 THEN CAST(0 AS double) WHEN 8 THEN NULL ELSE CAST(0.5 AS double) + CAST(extract(month FROM date) AS double) / CAST(16 AS double) END END AS factor
FROM (SELECT DISTINCT ticker, date FROM fx_prices WHERE ticker <> 'SPY' AND extract(day FROM date) % 3 = 2) p, (SELECT 'g1' AS generation UNION ALL SELECT 'g2') g""",
    "fx_decisions": """
SELECT DISTINCT ticker, disclosure_date AS decision_date FROM fx_purchases""",
}

_NEEDS = {
    "fx_prices": ["fx_sessions"],
    "fx_purchases": ["fx_disclosures"],
    "fx_decisions": ["fx_disclosures", "fx_purchases"],
    "fx_filings": ["fx_disclosures"],
    "fx_reports": ["fx_disclosures"],
    "fx_states": ["fx_sessions", "fx_prices"],
    "fx_factors": ["fx_sessions", "fx_prices"],
    "fx_outcomes": ["fx_disclosures", "fx_purchases"],
    "fx_runs": ["fx_disclosures"],
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _text(name: str, engine: str) -> str:
    return VIEWS.get(f"{name}@{engine}") or VIEWS[name]


def with_views(sql: str, *names: str) -> str:
    """DuckDB text of a query over the named views."""
    order: list[str] = []
    for n in (n for n in names if n not in TABLES):
        for x in (*_NEEDS.get(n, []), n):
            if x not in order:
                order.append(x)
    head = ",\n".join(f"{n} AS ({_text(n, 'duckdb')})" for n in order)
    sql = sql.strip()
    if not order:
        return sql
    first = "WITH RECURSIVE" if sql.startswith("WITH RECURSIVE ") else "WITH"
    return f"{first} {head}" + (f",\n{sql[len(first) + 1:]}" if sql.startswith("WITH ") else f"\n{sql}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in ``sf_dir``; sessions of several scales do not meet."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tag = f"t{abs(hash(sf_dir)) % 10**8}"
    text = _text(name, "spark")
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{tag}_{t}")

    for n in _NEEDS.get(name, []):
        view(spark, sf_dir, n).createOrReplaceTempView(f"{tag}_{n}")
    known = [*TABLES, *(v.split("@")[0] for v in VIEWS)]
    text = re.sub(r"\b(?:FROM|JOIN)\s+(\w+)", lambda m: m[0].replace(m[1], f"{tag}_{m[1]}") if m[1] in known else m[0], text)
    return spark.sql(text)
