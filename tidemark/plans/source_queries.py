"""Queries of the readers: the tables are written out in each format and read back; what is refused is counted with its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources.fixtures import view, with_views
from ..streaming.streams import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
D = "fx_disclosures"


def _query(name: str, sql: str, *views: str):
    """The function gets a new folder in the shared folder, and the views."""

    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(shared_path(spark, name), *(view(spark, sf_dir, v) for v in views))
        ORACLES[name] = with_views(sql, *views)
        return fn

    return keep


# Documents with the faults that an index can have, told by their number; the texts run in both engines.
_DOCS = f"SELECT doc_id, CAST(min(order_key) AS bigint) AS k, min(disclosure_date) AS filed, min(member) AS member, CAST(count(*) AS bigint) AS n FROM {D} GROUP BY doc_id"
_DAY = "concat(CAST(extract(month FROM filed) AS int), '/', CAST(extract(day FROM filed) AS int), '/', CAST(extract(year FROM filed) AS int))"
_LINE = f"concat_ws('\t', 'Hon.', member, {{first}}, '', 'P', CASE WHEN k % 53 = 0 THEN 'TX\t01' ELSE 'TX01' END, CAST(extract(year FROM filed) AS int), CASE WHEN k % 59 = 0 THEN '13/45/1998' ELSE {_DAY} END, CASE WHEN k % 61 = 0 THEN ' ' ELSE doc_id END)"
_LINES = f"SELECT {_LINE.format(first=chr(39) + 'A' + chr(39))} AS value FROM docs UNION ALL SELECT {_LINE.format(first='CASE WHEN k % 67 = 0 THEN ' + chr(39) + 'B' + chr(39) + ' ELSE ' + chr(39) + 'A' + chr(39) + ' END')} FROM docs WHERE k % 67 = 0 OR k % 71 = 0"


def _docs(d: DataFrame) -> DataFrame:
    return d.sparkSession.sql(_DOCS.replace(D, "{d}"), d=d)


def _sql(text: str, **tables: DataFrame) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    for n in tables:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **tables)


@_query(
    "s01_filing_index",
    f"""WITH docs AS ({_DOCS}), li AS (SELECT DISTINCT value, string_split(value, chr(9)) AS p FROM ({_LINES})), x AS (SELECT value, p, trim(p[9]) AS d, try_strptime(p[8], '%m/%d/%Y')::DATE AS f FROM li),
y AS (SELECT *, CASE WHEN len(p) <> 9 THEN 'ragged' WHEN d = '' THEN 'blank_doc_id' WHEN f IS NULL THEN 'bad_filing_date' WHEN count(*) FILTER (WHERE d <> '') OVER (PARTITION BY d) > 1 THEN 'conflicting_doc_id' END AS reason FROM x)
SELECT coalesce(reason, 'taken') AS outcome, CASE WHEN reason IS NULL THEN d ELSE value END AS what, CASE WHEN reason IS NULL THEN f END AS filing_date FROM y""",
    D,
)
def _(folder, d):
    _sql(_LINES, docs=_docs(d)).write.text(folder)
    good, bad = R.read_filing_index(d.sparkSession, folder)
    return good.select(F.lit("taken").alias("outcome"), F.col("doc_id").alias("what"), "filing_date").union(bad.select("reason", "value", F.lit(None).cast("date")))


_DAILY = """SELECT concat_ws('|', CASE WHEN k % 43 = 0 THEN 'x' ELSE CAST(k AS varchar(12)) END, member, CASE k % 3 WHEN 0 THEN '4' WHEN 1 THEN '4/A' ELSE '10-K' END, CASE WHEN k % 47 = 0 THEN 'soon' ELSE CAST(filed AS varchar(10)) END,
 concat('edgar/data/', k, '/', CASE WHEN k % 41 = 0 THEN 'none' ELSE concat(lpad(CAST(k AS varchar(12)), 10, '0'), '-', substr(CAST(filed AS varchar(10)), 3, 2), '-', lpad(CAST(k % 999983 AS varchar(12)), 6, '0')) END, '.txt')) AS value FROM docs
UNION ALL SELECT concat_ws('|', CAST(k AS varchar(12)), member, '4') FROM docs WHERE k % 73 = 0"""


@_query(
    "s02_daily_index",
    f"""WITH docs AS ({_DOCS}), li AS (SELECT value, string_split(value, '|') AS p FROM ({_DAILY})), y AS (SELECT *, len(p) = 5 AND p[1] <> 'x' AND p[4] <> 'soon' AND p[5] NOT LIKE '%none.txt' AS good FROM li WHERE p[3] IN ('4', '4/A'))
SELECT CASE WHEN good THEN p[1] END AS cik, CASE WHEN good THEN regexp_extract(p[5], '([0-9-]+)[.]txt', 1) END AS accession, CASE WHEN good THEN p[4]::DATE END AS filing_date, CASE WHEN NOT good THEN value END AS refused FROM y""",
    D,
)
def _(folder, d):
    _sql(_DAILY, docs=_docs(d)).write.text(folder)
    good, bad = R.read_daily_index(d.sparkSession, folder)
    return good.select("cik", "accession", "filing_date", F.lit(None).cast("string").alias("refused")).union(bad.select(*(F.lit(None).cast(t) for t in ("string", "string", "date")), "value"))


# A Form 4 of every document of officers: its rows are transactions; some lack what they need.
_FORMS = f"SELECT doc_id, CAST(order_key AS bigint) AS k, CAST(line_number AS int) AS place, CASE transaction_type WHEN 'Purchase' THEN 'P' WHEN 'Sale' THEN 's' ELSE 'A' END AS code, transaction_date AS day, CASE WHEN order_key % 31 = 0 AND line_number = 2 THEN 'many' ELSE CAST(CAST(quantity AS int) AS varchar(9)) END AS shares, concat(CAST(part_key % 90 + 1 AS int), '.', CAST(part_key % 4 * 25 AS int)) AS price, CAST(part_key AS bigint) AS part_key, CAST(supp_key AS bigint) AS supp_key FROM {D} WHERE source = 'form4'"


@_query(
    "s03_form4",
    f"""WITH f AS ({_FORMS}), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, part_key, supp_key, day, code, shares, price) AS n FROM f), m AS (SELECT * FROM g WHERE code <> 'A'),
b AS (SELECT doc_id, k, CASE WHEN k % 37 = 0 THEN 'owner name;' ELSE '' END || CASE WHEN k % 41 = 0 THEN 'ticker;' ELSE '' END || CASE WHEN bool_or(shares = 'many') THEN 'shares;' ELSE '' END AS reasons FROM m GROUP BY 1, 2)
SELECT doc_id AS member, CASE WHEN b.k % 41 <> 0 THEN concat('T', b.k % 7) ELSE '' END AS ticker, n::INT AS place, CASE code WHEN 'P' THEN 'Purchase' ELSE 'Sale' END AS transaction_type, day AS transaction_date, shares::DOUBLE * price::DOUBLE AS amount, b.k % 3 = 0 AS is_10b5_1, concat('Class A; ', shares, ' shares @ $', regexp_replace(regexp_replace(price, '([.][0-9]*?)0+$', '\\1'), '[.]$', ''), '; is_10b5_1=', b.k % 3 = 0) AS asset_description, NULL AS reasons FROM m JOIN b USING (doc_id) WHERE reasons = ''
UNION ALL SELECT CASE WHEN k % 37 = 0 THEN '' ELSE doc_id END, CASE WHEN k % 41 <> 0 THEN concat('T', k % 7) ELSE '' END, NULL, NULL, NULL, NULL, NULL, NULL, reasons FROM b WHERE reasons <> ''""",
    D,
)
def _(folder, d):
    f = _sql(_FORMS.replace(D, "d"), d=d)
    value = lambda c: F.struct(c.alias("value"))
    t = F.struct("place", "part_key", "supp_key", "day", "code", "shares", "price")
    per = f.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(t)).alias("ts"))  # a filing's rows
    rows = F.transform("ts", lambda x: F.struct(value(F.lit("Class A")).alias("securityTitle"), value(x["day"].cast("string")).alias("transactionDate"), F.struct(x["code"].alias("transactionCode")).alias("transactionCoding"), F.struct(value(x["shares"]).alias("transactionShares"), value(x["price"]).alias("transactionPricePerShare")).alias("transactionAmounts")))
    k = F.col("k")
    note = F.when(k % 3 == 0, F.array(F.lit("Made under a Rule 10b5-1 plan."))).otherwise(F.array(F.lit("not made pursuant to Rule 10b5-1")))
    xml = per.select(
        F.struct(F.when(k % 41 != 0, F.concat(F.lit("t"), k % 7)).otherwise(" ").alias("issuerTradingSymbol")).alias("issuer"), 
        F.struct(F.struct(F.when(k % 37 != 0, F.col("doc_id")).otherwise(" ").alias("rptOwnerName")).alias("reportingOwnerId")).alias("reportingOwner"), F.struct(rows.alias("nonDerivativeTransaction")).alias("nonDerivativeTable"), F.struct(note.alias("footnote")).alias("footnotes"))
    xml.write.format("xml").option("rootTag", "filings").option("rowTag", "ownershipDocument").save(folder)
    good, bad = R.read_form4(d.sparkSession, folder)
    none = lambda t: F.lit(None).cast(t)
    taken = good.select("member", "ticker", "place", "transaction_type", "transaction_date", "amount", "is_10b5_1", "asset_description", none("string").alias("reasons"))
    return taken.union(bad.select(F.coalesce("owner", F.lit("")), F.coalesce("ticker", F.lit("")), *(none(t) for t in ("int", "string", "date", "double", "boolean", "string")), F.concat(F.array_join("reasons", ";"), F.lit(";"))))


_INFO = f"SELECT member AS manager, CAST(order_key AS bigint) AS k, ticker AS cusip, CASE WHEN part_key % 997 = 0 THEN concat('Other ', ticker) WHEN part_key % 2 = 0 THEN concat('ISSUER ', ticker) ELSE concat('Issuer ', ticker) END AS issuer, CASE WHEN order_key % 1009 = 0 THEN 'x' WHEN member = 'MEMBER 5' AND line_number = 1 THEN '' ELSE CAST(CAST(quantity * 3 AS int) AS varchar(9)) END AS value, CAST(CAST(quantity AS int) AS varchar(9)) AS shares, CASE WHEN line_number = 3 THEN 'PRN' ELSE 'SH' END AS kind, CASE WHEN line_number = 4 THEN 'Put' ELSE '' END AS put_call FROM {D}"


@_query(
    "s04_13f_holdings",
    f"""WITH i AS (SELECT * FROM ({_INFO})), p AS (SELECT manager, cusip, min(issuer) AS issuer, count(DISTINCT lower(issuer)) AS names, sum(shares::BIGINT)::BIGINT AS shares, CASE WHEN count(*) FILTER (WHERE try_cast(value AS BIGINT) IS NULL) = 0 THEN sum(try_cast(value AS BIGINT)) END::BIGINT AS value FROM i WHERE kind = 'SH' AND put_call = '' GROUP BY 1, 2),
t AS (SELECT manager, bool_or(value = 'x') AS bad, CASE WHEN count(*) FILTER (WHERE try_cast(value AS BIGINT) IS NULL) = 0 THEN sum(try_cast(value AS BIGINT)) END::BIGINT AS total FROM i GROUP BY 1), r AS (SELECT manager, total, CASE WHEN bad THEN 'bad value;' ELSE '' END || CASE WHEN (SELECT bool_or(names > 1) FROM p WHERE p.manager = t.manager) THEN 'conflicting issuers;' ELSE '' END AS reasons FROM t)
SELECT manager, cusip, shares, value, total AS portfolio_value, NULL AS reasons FROM p JOIN r USING (manager) WHERE reasons = '' UNION ALL SELECT manager, NULL, NULL, NULL, NULL, reasons FROM r WHERE reasons <> ''""",
    D,
)
def _(folder, d):
    i = _sql(_INFO.replace(D, "d"), d=d)
    xml = i.select(F.translate("manager", " ", "_").alias("manager"), F.col("issuer").alias("nameOfIssuer"), "cusip", "value", F.nullif("put_call", F.lit("")).alias("putCall"), F.struct(F.col("shares").alias("sshPrnamt"), F.col("kind").alias("sshPrnamtType")).alias("shrsOrPrnAmt"))
    xml.repartition("manager").write.partitionBy("manager").format("xml").option("rootTag", "informationTable").option("rowTag", "infoTable").save(folder)
    manager = F.translate(F.regexp_extract("file", "manager=([^/]+)/", 1), "_", " ")
    good, bad = R.read_13f_holdings(d.sparkSession, f"{folder}/*", manager)
    none = F.lit(None).cast("long")
    return good.select(F.col("report").alias("manager"), "cusip", "shares", "value", "portfolio_value", F.lit(None).cast("string").alias("reasons")).union(bad.select("report", F.lit(None).cast("string"), none, none, none, F.concat(F.array_join("reasons", ";"), F.lit(";"))))


@_query(
    "s05_trade_pages",
    f"WITH p AS (SELECT CAST(order_key % 200 AS int) AS page, ticker, transaction_date, amount_midpoint FROM {D} WHERE order_key % 200 <> 77) SELECT page, ticker, CAST(transaction_date AS VARCHAR) AS date, count(*) AS n, NULL AS problem FROM p GROUP BY 1, 2, 3 UNION ALL SELECT NULL, NULL, NULL, NULL, unnest(['page_count', 'trade_count']) WHERE (SELECT count(*) FROM {D} WHERE order_key % 200 = 77) > 0",
    D,
)
def _(folder, d):
    page = (F.col("order_key") % 200).cast("int")
    total = d.count()  # what the pages say that there are
    pages = d.groupBy(page.alias("page")).agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), "ticker", F.col("transaction_date").cast("string").alias("date"), F.col("amount_midpoint").cast("string").alias("amount"))).alias("trades"))
    told = F.lit(200).alias("pages"), F.lit(total).alias("total"), F.lit(100).alias("perPage")
    pages.where("page <> 77").select("page", *told, "trades").write.json(folder)
    trades, problems = R.read_trade_pages(d.sparkSession, folder, multi_line=False)
    seen = trades.groupBy("page", "ticker", "date").agg(F.count(F.lit(1)).alias("n"))
    return seen.withColumn("problem", F.lit(None).cast("string")).union(problems.select(*(F.lit(None).cast(t) for t in ("int", "string", "string", "long")), "problem"))


_THIRD = f"SELECT CASE WHEN part_key % 61 = 0 THEN ' ' ELSE member END AS member, CASE WHEN part_key % 67 = 0 THEN '2001-02-30' WHEN part_key % 71 = 0 THEN '1/2/1998' ELSE CAST(transaction_date AS varchar(10)) END AS transaction_date, CASE WHEN part_key % 73 <> 0 THEN ticker END AS ticker, concat('$', CAST(part_key % 90 AS int), ',001, or more') AS amount_band, doc_id AS source_doc_id FROM {D}"
_THIRD_GOOD = "trim(member) <> '' AND ticker IS NOT NULL AND transaction_date NOT IN ('2001-02-30', '1/2/1998')"


@_query("s07_third_party_trades", f"SELECT member, CASE WHEN good THEN transaction_date END AS transaction_date, ticker, amount_band, source_doc_id, good AS taken FROM (SELECT *, {_THIRD_GOOD} AS good FROM ({_THIRD}))", D)
def _(folder, d):
    _sql(_THIRD.replace(D, "d"), d=d).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    good, bad = R.read_third_party_trades(d.sparkSession, folder)
    return good.withColumns({"transaction_date": F.col("transaction_date").cast("string"), "taken": F.lit(True)}).unionByName(bad.withColumns({"transaction_date": F.lit(None).cast("string"), "taken": F.lit(False)}))


_FILL = f"SELECT lower(ticker) AS Symbol, CASE WHEN part_key % 83 = 0 THEN 'free' ELSE concat(CAST(part_key % 90 + 1 AS int), '.5 db') END AS Price, CASE WHEN part_key % 89 = 0 THEN 'what' ELSE concat(CASE WHEN part_key % 2 = 0 THEN '-' ELSE '' END, CAST(quantity AS int), ' ', CASE transaction_type WHEN 'Purchase' THEN 'BTO' WHEN 'Sale' THEN 'stc' ELSE 'STO' END, ' now') END AS Description, CASE WHEN part_key % 97 = 0 THEN '2/30, 4:30p' ELSE concat(CAST(extract(month FROM transaction_date) AS int), '/', CAST(extract(day FROM transaction_date) AS int), ', 4:30p') END AS Time, doc_id AS orders FROM {D}"


@_query(
    "s08_broker_fills",
    f"""WITH f AS (SELECT *, Price <> 'free' AND Description <> 'what' AND Time <> '2/30, 4:30p' AS good FROM ({_FILL}))
SELECT orders AS order_number, CASE WHEN good THEN upper(Symbol) ELSE Symbol END AS symbol, CASE WHEN good THEN upper(split_part(Description, ' ', 2)) END AS side, CASE WHEN good THEN abs(split_part(Description, ' ', 1)::INT) * CASE WHEN Description LIKE '%STO%' THEN -1 ELSE 1 END END::DOUBLE AS quantity, CASE WHEN good THEN split_part(Price, ' ', 1)::DOUBLE END AS price,
 CASE WHEN good THEN make_date(2000, split_part(Time, '/', 1)::INT, split_part(split_part(Time, '/', 2), ',', 1)::INT) END AS day FROM f""",
    D,
)
def _(folder, d):
    _sql(_FILL.replace(D, "d"), d=d).write.option("header", True).option("sep", "\t").csv(folder)
    good, bad = R.read_broker_fills(d.sparkSession, folder, 2000)
    columns = ["order_number", "symbol", "side", "quantity", "price", "day"]
    return good.select(*columns).union(bad.select("order_number", "symbol", *(F.lit(None).cast(t) for t in ("string", "double", "double", "date"))))


@_query("s09_staged_records", f"SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'no_txs' ELSE 'success' END AS status, CASE WHEN n % 7 = 0 THEN 0 ELSE n END AS n_rows, CASE WHEN n % 7 <> 0 THEN n END AS found FROM (SELECT doc_id, count(*) AS n FROM {D} GROUP BY 1)", D)
def _(folder, d):
    rows = F.collect_list(F.struct("source_row_id", "ticker", "transaction_type", F.col("amount_midpoint").cast("string").alias("amount_raw"))).alias("rows")
    docs = d.groupBy("doc_id").agg(rows).withColumn("status", F.when(F.size("rows") % 7 == 0, "no_txs").otherwise("success"))
    docs.withColumn("rows", F.when(F.col("status") == "success", F.col("rows"))).write.json(folder)
    held, found = R.read_staged_records(d.sparkSession, folder, multi_line=False)
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    return held.select("doc_id", "status", F.col("n_rows").cast("long").alias("n_rows")).join(n, "doc_id", "left")


# A file of every document: some are web pages, some have no trailer, some have it too far from the end.
_PDF = "SELECT doc_id, CAST(extract(year FROM filed) AS int) AS year, CASE WHEN k % 7 = 0 THEN '<html>%%EOF' WHEN k % 11 = 0 THEN concat('%PDF-1.4 ', member) WHEN k % 13 = 0 THEN concat('%PDF-1.4 %%EOF', repeat('x', 1100)) ELSE concat('%PDF-1.7 ', doc_id, repeat(' ', CAST(k % 1000 AS int)), '%%EOF ') END AS content, k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AS fine FROM docs"


@_query("s10_document_inventory", f"WITH docs AS ({_DOCS}) SELECT year, doc_id, sha256(content) AS artifact_sha256, fine AS is_valid_pdf FROM ({_PDF})", D)
def _(folder, d):
    files = _sql(_PDF, docs=_docs(d)).select(F.concat(F.col("year").cast("string"), F.lit("/pdfs/"), "doc_id", F.lit(".pdf")).alias("path"), "content")
    R.write_documents(files, folder)
    return R.scan_document_inventory(d.sparkSession, folder)


@_query("s15_price_snapshot", "SELECT ticker, count(*) AS days, max(close) AS high FROM fx_prices WHERE close > 0 GROUP BY 1", "fx_prices")
def _(folder, prices):
    R.write_price_snapshot(prices.where("ticker < 'TC'"), folder)
    R.write_price_snapshot(prices, folder)  # readers follow the manifest to this one
    return R.read_price_snapshot(prices.sparkSession, folder).where("close > 0").groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.max("close").alias("high"))


@_query("s16_write_results", f"SELECT form, doc_id, n FROM (SELECT doc_id, count(*) AS n FROM {D} GROUP BY 1), (SELECT unnest(['csv', 'json', 'parquet']) AS form)", D)
def _(folder, d):
    per, out = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), None
    for form in ("csv", "json", "parquet"):
        R.write_results(per, f"{folder}/{form}", form)
        back = d.sparkSession.read.format(form).schema("doc_id string, n long").option("header", form == "csv").load(f"{folder}/{form}").select(F.lit(form).alias("form"), "doc_id", "n")
        out = back if out is None else out.union(back)
    return out
