"""Queries of the scalar rules over whole fixture views, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, source: str, keys: list[str], columns: Callable[[], dict[str, Column]], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select(*keys, *(c.alias(n) for n, c in columns().items()))

    QUERIES[name] = run
    ORACLES[name] = with_views(f"SELECT {', '.join(keys)}, {sql} FROM {source}", source)


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_C = F.col
_TYPE = "lower(trim(coalesce(type_text, '')))"
_add(
    "n01_normalize_transaction_type", "fx_text", ["row_key"], lambda: {"transaction_type": S.normalize_transaction_type(_C("type_text"))},
    rf"""CASE WHEN regexp_matches({_TYPE}, '\b(p|purchase|buy)\b')::INT + regexp_matches({_TYPE}, '\b(s|sale|sell|sold)\b')::INT + regexp_matches({_TYPE}, '\b(e|exchange)\b')::INT > 1 THEN NULL
 WHEN regexp_matches({_TYPE}, '\b(p|purchase|buy)\b|purchase') THEN 'Purchase' WHEN regexp_matches({_TYPE}, '\b(s|sale|sell|sold)\b') THEN 'Sale'
 WHEN regexp_matches({_TYPE}, '\b(e|exchange)\b|exchange') THEN 'Exchange' WHEN regexp_matches({_TYPE}, '^p.?$') THEN 'Purchase' WHEN regexp_matches({_TYPE}, '^s.?$') THEN 'Sale' END AS transaction_type""",
)
_OWNER = "upper(trim(coalesce(owner_text, '')))"
_owner_sql = f"CASE WHEN {_OWNER} LIKE 'DEPENDENT%' OR {_OWNER} LIKE 'CHILD%' OR {_OWNER} = 'DC' THEN 'DC' WHEN {_OWNER} LIKE 'SPOUSE%' OR {_OWNER} = 'SP' THEN 'SP' WHEN {_OWNER} LIKE 'JOINT%' OR {_OWNER} = 'J' THEN 'J' WHEN {_OWNER} = 'JT' THEN 'JT' WHEN {_OWNER} LIKE 'SELF%' OR {_OWNER} = 'S' THEN 'S' ELSE '' END"
_add("n02_normalize_owner", "fx_text", ["row_key"], lambda: {"owner": S.normalize_owner(_C("owner_text")), "account": S.account_owner(_C("owner_text"))}, f"{_owner_sql} AS owner, CASE WHEN ({_owner_sql}) = 'JT' THEN 'J' ELSE ({_owner_sql}) END AS account")
_A = "lower(asset_text)"
_AFTER = rf"CASE WHEN contains({_A}, '[op]') THEN regexp_extract({_A}, '\[op\]([\s\S]*)', 1) ELSE {_A} END"
_add(
    "n03_classify_instrument", "fx_text", ["row_key"], lambda: {"instrument": S.classify_instrument(_C("asset_text"))},
    rf"""CASE WHEN asset_text IS NULL OR asset_text = '' THEN 'unknown' WHEN regexp_matches({_A}, 'simple agreement for future equity|\bconvertible\s+safe\b') THEN 'private'
 WHEN regexp_matches({_A}, '\btreasury\s+(bill|note|bond)s?\b') THEN 'treasury' WHEN regexp_matches({_A}, '\[(cb|mb)\]|\b(corporate|municipal)\s+bonds?\b') THEN 'bond'
 WHEN contains({_A}, '[st]') THEN 'stock' WHEN contains({_A}, '[ct]') THEN 'other' WHEN contains({_A}, '[gs]') THEN 'Government Securities' WHEN contains({_A}, '[cs]') THEN 'bond' WHEN contains({_A}, '[ot]') THEN 'other'
 WHEN regexp_matches({_AFTER}, '\bput\s+opt(ion)?\b|\bstock\s+put\b|\bput\b.*\b(strike|exp|expir)\b') THEN 'put'
 WHEN regexp_matches({_AFTER}, '\bcall\s+opt(ion)?\b|\bstock\s+call\b|\bcall\b.*\b(strike|exp|expir)\b') THEN 'call'
 WHEN regexp_matches({_A}, '\[op\]|\boption\b') THEN 'option' ELSE 'stock' END AS instrument""",
)
_V = r"list_transform(regexp_extract_all(trim(coalesce(amount_text, '')), '\$([0-9][0-9,]*)', 1), lambda x: replace(x, ',', '')::DOUBLE)"
_add(
    "n04_amount_midpoint", "fx_text", ["row_key"], lambda: {"midpoint": S.amount_midpoint(_C("amount_text"), _C("row_key").cast("double"))},
    f"CASE WHEN trim(coalesce(amount_text, '')) LIKE '%-' THEN NULL WHEN len({_V}) >= 2 THEN ({_V}[1] + {_V}[2]) / 2 WHEN len({_V}) = 1 AND floor({_V}[1])::BIGINT % 1000 = 1 THEN NULL ELSE row_key::DOUBLE END AS midpoint",
)
_TOKENS = r"regexp_extract_all(coalesce(amount_text, ''), '\$([0-9.,]+)', 1)"
_MONEY = f"list_transform({_TOKENS}, lambda x: replace(x, ',', '')::DOUBLE)"
_KIND = rf"""CASE WHEN len({_TOKENS}) = 0 OR len(list_filter({_TOKENS}, lambda x: NOT regexp_full_match(x, '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\.[0-9]{{2}})?'))) > 0 THEN 'unknown' WHEN amount_text ILIKE 'over %' OR amount_text LIKE '%-' THEN 'open' WHEN len({_TOKENS}) > 1 THEN 'range' ELSE 'exact' END"""
_add(
    "n05_parse_amount", "fx_text", ["row_key"], lambda: {f"amount_{f}": S.parse_amount(_C("amount_text"))[f] for f in ("kind", "lower", "upper", "midpoint")},
    f"""{_KIND} AS amount_kind, CASE WHEN {_KIND} <> 'unknown' THEN {_MONEY}[1] END AS amount_lower, CASE {_KIND} WHEN 'range' THEN {_MONEY}[2] WHEN 'exact' THEN {_MONEY}[1] END AS amount_upper,
 CASE {_KIND} WHEN 'range' THEN ({_MONEY}[1] + {_MONEY}[2]) / 2 WHEN 'exact' THEN {_MONEY}[1] END AS amount_midpoint""",
)
_add(
    "n06_parse_disclosure_date", "fx_text", ["row_key"], lambda: {"parsed": S.parse_disclosure_date(_C("date_text"))},
    r"""coalesce(try_strptime(nullif(regexp_extract(date_text, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}'), ''), '%m/%d/%Y')::DATE, try_strptime(nullif(regexp_extract(date_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ''), '%Y-%m-%d')::DATE,
 CASE WHEN NOT regexp_matches(date_text, '/[0-9]{4}') AND regexp_matches(date_text, '^[0-9]+/[0-9]+/[0-9]{2}') THEN try_strptime(regexp_replace(date_text, '/([0-9]{2})$', '/' || CASE WHEN right(date_text, 2)::INT >= 50 THEN '19' ELSE '20' END || '\1'), '%m/%d/%Y')::DATE END) AS parsed""".replace("right(date_text, 2)::INT", "try_cast(right(date_text, 2) AS INT)"),
)
_SYMBOLS = ", ".join(f"CASE WHEN regexp_extract(asset_text, '{p}', 1) NOT IN ('', 'SP') THEN regexp_extract(asset_text, '{p}', 1) END" for p in (r"\(([A-Z]{1,5})\)", r"\$([A-Z]{1,5})\b", r"\b([A-Z]{1,5}):"))
_add("n07_extract_ticker", "fx_text", ["row_key"], lambda: {"symbol": S.extract_ticker(_C("asset_text"))}, f"coalesce({_SYMBOLS}) AS symbol")
_add(
    "n08_normalize_company_name", "fx_text", ["row_key"], lambda: {"company": S.normalize_company_name(_C("asset_text"))},
    r"trim(regexp_replace(trim(regexp_replace(replace(upper(asset_text), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), '(\s+(CMN|COMMON STOCK|CLASS [ABC]|INC|INCORPORATED|CORP|CORPORATION|COMPANY|COS|LLC|LTD|LIMITED|PLC|HOLDINGS|HOLDING|GROUP|LP|LLP|PA|NA))+$', '')) AS company",
)
_add(
    "n09_extract_option_terms", "fx_text", ["row_key"], lambda: {f"option_{f}": S.extract_option_terms(_C("asset_text"))[f] for f in ("strike", "expiry")},
    r"""replace(nullif(regexp_extract(asset_text, 'strike (?:price )?\$([0-9,]+\.[0-9]{2})', 1), ''), ',', '')::DOUBLE AS option_strike,
 try_strptime(nullif(regexp_extract(asset_text, 'exp ([0-9]+/[0-9]+/)', 1) || CASE WHEN regexp_matches(asset_text, 'exp [0-9]+/[0-9]+/[0-9]{2}$') THEN '20' ELSE '' END || regexp_extract(asset_text, 'exp [0-9]+/[0-9]+/([0-9]+)', 1), ''), '%m/%d/%Y')::DATE AS option_expiry""",
)
# The key by the parts that a name was made of, not by its text.
_SUR = "upper(concat('Q', translate(row_key::INT::VARCHAR, '0123456789', 'abcdefghij')))"
_FIRST_NAMES = {0: "RENEE", 1: "JOHN", 2: "MICHAEL T", 3: "NEAL PATRICK", 4: "JD", 7: "JOSE E", 8: "LEE", 10: "JD", 11: "MIKE"}
_key_sql = "CASE row_key % 12 " + " ".join(f"WHEN {i} THEN concat('{f} ', {_SUR})" for i, f in _FIRST_NAMES.items()) + " ELSE '' END"
_add("n10_canonical_member_key", "fx_text", ["row_key"], lambda: {"member_key": S.canonical_member_key(_C("name_text"))}, f"{_key_sql} AS member_key")
_add(
    "n11_actor_id", "fx_text", ["row_key"], lambda: {"chamber_key": S.chamber_member_key(F.lit("Senate"), _C("name_text")), "congress_id": S.actor_id(F.lit("congress"), _C("name_text")), "officer_id": S.actor_id(F.lit("officer"), _C("name_text"))},
    f"CASE WHEN ({_key_sql}) = '' THEN '' ELSE 'senate:' || ({_key_sql}) END AS chamber_key, 'congress:' || ({_key_sql}) AS congress_id, 'officer:' || upper(trim(regexp_replace(name_text, '\\s+', ' ', 'g'))) AS officer_id",
)
_TK = f"CASE WHEN upper(trim(ticker_text)) IN ('', {_list(S.MISSING_TICKERS)}) THEN NULL ELSE upper(trim(ticker_text)) END"
_add("n12_normalize_ticker", "fx_text", ["row_key"], lambda: {"symbol": S.normalize_ticker(_C("ticker_text")), "valid": S.is_valid_ticker(_C("ticker_text"))}, f"{_TK} AS symbol, coalesce(regexp_full_match({_TK}, '[A-Z]{{1,5}}([.-][A-Z]{{1,2}})?') AND ({_TK}) NOT IN ({_list(S.NON_EQUITY_TICKERS)}), false) AS valid")
_add(
    "n13_cusip_is_valid", "fx_text", ["row_key"], lambda: {"valid": S.cusip_is_valid(_C("cusip_text"))},
    """regexp_full_match(upper(trim(cusip_text)), '[0-9A-Z*@#]{8}[0-9]') AND ((10 - list_sum(list_transform(generate_series(1, 8), lambda i:
 (((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#', substr(cusip_text, i::INT, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) // 10)
 + (((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#', substr(cusip_text, i::INT, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) % 10))) % 10) % 10)::INT::VARCHAR = substr(cusip_text, 9, 1) AS valid""",
)
_add(
    "n15_filed_lot", "fx_text", ["row_key"], lambda: {f"lot_{f}": S.filed_lot(_C("lot_text"))[f] for f in ("shares", "price")},
    r"replace(nullif(regexp_extract(lower(lot_text), '([0-9][0-9.,]*) shares? ', 1), ''), ',', '')::DOUBLE AS lot_shares, replace(nullif(regexp_extract(lower(lot_text), 'shares? (?:@|at) \$ ?([0-9.,]+)', 1), ''), ',', '')::DOUBLE AS lot_price",
)
_add(
    "n16_row_identity_key", "fx_disclosures", ["doc_id", "source_row_id"],
    lambda: {"identity": S.row_fingerprint(S.clean_identity_text(_C("asset_description")), _C("transaction_type"), _C("transaction_date"), _C("owner_code"))},
    r"sha256(concat_ws('|', '=' || lower(trim(regexp_replace(asset_description, '\s+', ' ', 'g'))), '=' || transaction_type, '=' || transaction_date, '=' || owner_code)) AS identity",
)
_add("n17_clean_identity_text", "fx_text", ["row_key"], lambda: {"cleaned": S.clean_identity_text(_C("name_text"))}, r"CASE WHEN lower(trim(regexp_replace(name_text, '\s+', ' ', 'g'))) IN ('', 'nan', 'none', 'null', 'n/a', '<na>') THEN NULL ELSE lower(trim(regexp_replace(name_text, '\s+', ' ', 'g'))) END AS cleaned")
_add("n18_parse_source_family", "fx_text", ["row_key"], lambda: {"family": S.parse_source_family(_C("parser_text"))}, "CASE WHEN parser_text ILIKE '%gemini%' OR parser_text ILIKE '%ocr%' THEN 'gemini_ocr' WHEN parser_text ILIKE '%house%' OR parser_text ILIKE '%pdf%' THEN 'house_pdf' WHEN parser_text ILIKE '%senate%' THEN 'senate_efd' WHEN parser_text ILIKE '%form4%' THEN 'form4' WHEN parser_text ILIKE '%13f%' THEN '13f' ELSE 'unknown' END AS family")
_add(
    "n21_row_fingerprint", "fx_disclosures", ["doc_id", "source_row_id", "ticker"], lambda: {"fingerprint": S.row_fingerprint(_C("member"), _C("raw_transaction_subtype"), _C("source"))},
    "sha256(concat_ws('|', coalesce('=' || member, '~'), coalesce('=' || raw_transaction_subtype, '~'), coalesce('=' || source, '~'))) AS fingerprint",
)
_add("n25_kelly_fraction", "fx_text", ["row_key"], lambda: {"half_kelly": S.kelly_fraction((_C("row_key") % 100) / 100.0, _C("row_key") % 7 + 1.0, _C("row_key") % 5 + 1.0)}, "greatest(((row_key % 100) / 100.0::DOUBLE * ((row_key % 7 + 1.0::DOUBLE) / (row_key % 5 + 1.0::DOUBLE)) - (1 - (row_key % 100) / 100.0::DOUBLE)) / ((row_key % 7 + 1.0::DOUBLE) / (row_key % 5 + 1.0::DOUBLE)), 0.0) * 0.5 AS half_kelly")
_add("n26_skill_weight", "fx_text", ["row_key"], lambda: {"weight": S.skill_weight((_C("row_key") % 30).cast("double"), (_C("row_key") % 30 + _C("row_key") % 11).cast("double"), F.lit(0.46))}, "((row_key % 30)::DOUBLE + 0.46::DOUBLE * 20.0::DOUBLE) / ((row_key % 30 + row_key % 11)::DOUBLE + 20.0::DOUBLE) AS weight")
_add("n27_evidence_decay", "fx_disclosures", ["doc_id", "source_row_id"], lambda: {"decay": S.evidence_decay(F.lit("1998-06-01").cast("date"), _C("disclosure_date"))}, "CASE WHEN disclosure_date <= DATE '1998-06-01' AND disclosure_date >= DATE '1998-04-01' THEN pow(0.5::DOUBLE, date_diff('day', disclosure_date, DATE '1998-06-01') / 90.0::DOUBLE) END AS decay")
_add("n28_disclosure_lag", "fx_disclosures", ["doc_id", "source_row_id"], lambda: {"lag_days": S.disclosure_lag(_C("transaction_date"), _C("disclosure_date"))}, "date_diff('day', transaction_date, disclosure_date) AS lag_days")
_add("n29_poisson_base_rate", "fx_text", ["row_key"], lambda: {"chance": S.poisson_base_rate((_C("row_key") % 40).cast("double"), F.lit(365.0), F.lit(14.0))}, "1 - exp(-(row_key % 40)::DOUBLE / 365.0::DOUBLE * 14.0::DOUBLE) AS chance")
_add(
    "n30_chronology_violations", "fx_disclosures", ["doc_id", "source_row_id"], lambda: {"reasons": F.array_join(S.chronology_violations(_C("transaction_date"), _C("disclosure_date"), F.date_add(_C("transaction_date"), (_C("line_number") - 2).cast("int"))), ",")},
    "concat_ws(',', CASE WHEN transaction_date > disclosure_date THEN 'trade_after_disclosure' END, CASE WHEN line_number < 2 THEN 'notification_before_trade' END, CASE WHEN transaction_date < DATE '1995-06-01' OR transaction_date > DATE '2001-06-30' THEN 'outside_domain' END) AS reasons",
)
_add("n32_option_return_guard", "fx_text", ["row_key"], lambda: {f"guard_{f}": S.option_return_guard(S.classify_instrument(_C("asset_text")))[f] for f in ("leverage", "reason")}, ORACLES["n03_classify_instrument"].split("SELECT row_key, ")[-1].rsplit(" AS instrument", 1)[0].join(("CASE WHEN (", ") = 'stock' THEN 1.0::DOUBLE END AS guard_leverage, ")) + ORACLES["n03_classify_instrument"].split("SELECT row_key, ")[-1].rsplit(" AS instrument", 1)[0].join(("CASE WHEN (", ") <> 'stock' THEN 'unsupported_instrument_pricing' END AS guard_reason")))
_add("n33_classify_scan", "fx_text", ["row_key"], lambda: {"scan": S.classify_scan(_C("row_key") % 300, _C("row_key") % 400)}, "CASE WHEN row_key % 300 > 200 THEN 'text_missed' WHEN row_key % 400 < 200 THEN 'low_resolution' ELSE 'scanned' END AS scan")
