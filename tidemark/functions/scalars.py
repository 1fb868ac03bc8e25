"""Scalar rules as Column builders: all of it stays inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HONORIFICS = ["DR", "MR", "MRS", "MS", "HON", "HONORABLE", "REP", "SEN", "SR", "JR", "II", "III", "IV"]
CREDENTIALS = ["MD", "FACS", "FACP", "FACC", "DDS", "DMD", "PHD", "PH", "EDD", "JD", "RN", "LPN", "CRNA", "DVM", "DPM", "PHARMD", "MBA", "MPH", "MSN", "MSW", "CPA", "CPC", "ESQ"]
MISSING_MEMBERS = ["N A", "NA", "NONE", "NAN", "NULL", "UNKNOWN", "UNKNOWN MEMBER", "NOT AVAILABLE"]
MISSING_TICKERS = ["NAN", "NAT", "NONE", "<NA>"]
NON_EQUITY_TICKERS = ["BOND", "BONDS", "CASH", "COUPON", "FUND", "NOTE", "NOTES", "STOCK", "TICKER"]
OWNERS = {"DEPENDENT": "DC", "DEPENDENT CHILD": "DC", "DC": "DC", "SPOUSE": "SP", "SP": "SP", "JOINT": "J", "JT": "JT", "J": "J", "SELF": "S", "S": "S"}
ACCENTS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
TICKER_FORM = "^[A-Z]{1,5}(?:[.-][A-Z]{1,2})?$"
CURRENCY = "(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]{2})?"


# Fixed values.
COMPANY_TAILS = ["CMN", "COMMON STOCK", "CLASS [ABC]", "INC", "INCORPORATED", "CORP", "CORPORATION", "COMPANY", "COS", "LLC", "LTD", "LIMITED", "PLC", "HOLDINGS", "HOLDING", "GROUP", "LP", "LLP", "PA", "NA"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Blanks collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def clean_identity_text(c: Column) -> Column:
    """Collapsed, lower case; empty and missing markers are null."""
    low = F.lower(clean_text(c))
    return F.when(low.isin("", "nan", "none", "null", "n/a", "<na>"), None).otherwise(low)


def normalize_transaction_type(c: Column) -> Column:
    """Free text to Purchase, Sale or Exchange; texts with two directions, and others, are null."""
    s = F.lower(F.trim(_text(c)))
    buy, sell, swap = s.rlike("\\b(?:p|purchase|buy)\\b"), s.rlike("\\b(?:s|sale|sell|sold)\\b"), s.rlike("\\b(?:e|exchange)\\b")
    directions = buy.cast("int") + sell.cast("int") + swap.cast("int")
    return F.when(directions > 1, None).when(buy | s.contains("purchase"), "Purchase").when(sell, "Sale").when(swap | s.contains("exchange"), "Exchange").when(s.rlike("^p.?$"), "Purchase").when(s.rlike("^s.?$"), "Sale")


def normalize_owner(c: Column) -> Column:
    """Owner text to S, SP, DC, J or JT; anything else is ''."""
    s = F.upper(F.trim(_text(c)))
    exact = F.create_map(*(F.lit(x) for kv in OWNERS.items() for x in kv))[s]
    begins = F.when(s.startswith("DEPENDENT") | s.startswith("CHILD"), "DC").when(s.startswith("SPOUSE"), "SP").when(s.startswith("JOINT"), "J").when(s.startswith("SELF"), "S")
    return F.coalesce(exact, begins, F.lit(""))


def account_owner(c: Column) -> Column:
    """The account form of an owner code: J and JT are one account."""
    code = normalize_owner(c)
    return F.when(code == "JT", "J").otherwise(code)


def classify_instrument(c: Column) -> Column:
    """Asset text to its instrument; codes in brackets win, in this order."""
    s = F.lower(c)
    stock = s.rlike("\\[st\\]")
    told = F.when(s.rlike("^\\s*(?:description|d)\\s*:") & stock, F.substring_index(s, "[st]", -1)).otherwise(s)
    after = F.when(s.contains("[op]"), F.regexp_extract(s, "\\[op\\]([\\s\\S]*)", 1)).otherwise(s)
    put = after.rlike("\\bput\\s+opt(?:ion)?\\b|\\bstock\\s+put\\b|\\bput\\b.*\\b(?:strike|exp|expir)\\b")
    call = after.rlike("\\bcall\\s+opt(?:ion)?\\b|\\bstock\\s+call\\b|\\bcall\\b.*\\b(?:strike|exp|expir)\\b")
    return (
        F.when(c.isNull() | (c == ""), "unknown")
        .when(told.rlike("\\bsimple agreement for future equity\\b|\\bconvertible\\s+safe\\b"), "private")
        .when(told.rlike("\\btreasury\\s+(?:bill|note|bond)s?\\b"), "treasury")
        .when(told.rlike("\\[(?:cb|mb)\\]|\\b(?:corporate|municipal)\\s+bonds?\\b"), "bond")
        .when(stock, "stock")
        .when(s.rlike("\\[ct\\]"), "other")
        .when(s.rlike("\\[gs\\]"), "Government Securities")
        .when(s.rlike("\\[cs\\]"), "bond")
        .when(s.rlike("\\[ot\\]"), "other")
        .when(put, "put")
        .when(call, "call")
        .when(s.rlike("\\[op\\]|\\boption\\b"), "option")
        .otherwise("stock")
    )


def _dollars(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def amount_midpoint(raw: Column, midpoint: Column) -> Column:
    """The middle of a dollar band; open bands and a single floor x001 give null; else the given midpoint."""
    s = F.trim(_text(raw))
    v = _dollars(s, "\\$([0-9][0-9,]*)")
    floor_only = (F.size(v) == 1) & (F.floor(F.element_at(v, 1)) % 1000 == 1)
    given = F.when(F.isnan(midpoint), None).otherwise(midpoint)
    return F.when(s.endswith("-"), None).when(F.size(v) >= 2, (v[0] + v[1]) / 2).when(F.size(v) == 0, given).when(floor_only, None).otherwise(given)


def parse_amount(c: Column) -> Column:
    """Struct of kind (exact, range, open, unknown), lower, upper and midpoint."""
    s = clean_text(_text(c))
    v = _dollars(s, f"\\$({CURRENCY})")
    unclear = F.size(F.regexp_extract_all(s, F.lit("\\$([0-9.,]+)"), F.lit(1))) != F.size(F.regexp_extract_all(s, F.lit(f"\\$({CURRENCY})(?:[^0-9.,]|$)"), F.lit(1)))
    open_ = F.lower(s).rlike("\\b(?:over|greater than|less than|under)\\b|[<>+]") | s.endswith("-")
    kind = F.when(unclear | (F.size(v) == 0), "unknown").when(open_, "open").when(F.size(v) >= 2, "range").otherwise("exact")
    lower = F.when(kind != "unknown", F.get(v, F.lit(0)))
    upper = F.when(kind == "range", F.get(v, F.lit(1))).when(kind == "exact", F.get(v, F.lit(0)))
    return F.struct(kind.alias("kind"), lower.alias("lower"), upper.alias("upper"), ((lower + upper) / 2).alias("midpoint"))


def parse_disclosure_date(c: Column) -> Column:
    """M/D/YYYY, M/D/YY (50 and later: 19yy) or ISO inside a text; impossible dates are null."""
    s = _text(c)
    iso, long, short = F.regexp_extract(s, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})"

    def mdy(pattern: str, year: Column) -> Column:
        day = F.concat_ws("-", year, F.lpad(F.regexp_extract(s, pattern, 1), 2, "0"), F.lpad(F.regexp_extract(s, pattern, 2), 2, "0"))
        return F.when(F.regexp_extract(s, pattern, 3) != "", F.try_to_date(day, "yyyy-MM-dd"))

    yy = F.regexp_extract(s, short, 3)
    century = F.concat(F.when(yy.cast("int") >= 50, "19").otherwise("20"), yy)
    from_iso = F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd"))
    return F.when(F.regexp_extract(s, long, 3) != "", mdy(long, F.regexp_extract(s, long, 3))).when(iso != "", from_iso).otherwise(mdy(short, century))


def extract_option_terms(c: Column) -> Column:
    """Struct of strike and expiry from contract text after the bracket code; nothing is made up."""
    s = F.lower(_text(c))
    after = F.when(s.contains("[op]"), F.regexp_extract(s, "\\[op\\]([\\s\\S]*)", 1)).otherwise(s)
    end = "(?:[^0-9.,]|$)"
    first = F.regexp_extract(after, f"strike\\s*(?:price)?(?:\\s+of)?[:\\s]*\\$?({CURRENCY}){end}", 1)
    second = F.regexp_extract(after, f"\\$({CURRENCY})\\s+(?:exp|strike)", 1)
    strike = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    expiry = F.regexp_extract(after, "exp(?:ir(?:e|ation|ing)?)?(?:\\s+date)?(?:\\s+of)?[:\\s]+([0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2}))(?:[^0-9]|$)", 1)
    return F.struct(F.regexp_replace(strike, ",", "").cast("double").alias("strike"), parse_disclosure_date(expiry).alias("expiry"))


def extract_ticker(c: Column) -> Column:
    """A symbol in parentheses, after a dollar sign, or before a colon; stop words and codes are not symbols."""
    s = _text(c)
    stop = ["ST", "OP", "CT", "GS", "CS", "OT", "SP", "JT", "DC", "D", "DESCRIPTION", *NON_EQUITY_TICKERS]
    found = [F.regexp_extract(s, p, 1) for p in ("\\(([A-Z]{1,5}(?:[.-][A-Z]{1,2})?)\\)", "\\$([A-Z]{1,5}(?:[.-][A-Z]{1,2})?)\\b", "\\b([A-Z]{1,5}(?:[.-][A-Z]{1,2})?):")]
    return F.coalesce(*(F.when((x != "") & ~x.isin(*stop), x) for x in found))


def normalize_company_name(c: Column) -> Column:
    """Upper case, & as AND, punctuation to blanks, then words for classes and legal forms off the end, one after the other; never the last word."""
    s = F.trim(F.regexp_replace(F.replace(F.upper(_text(c)), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))
    return F.trim(F.regexp_replace(s, f"(?:\\s+(?:{'|'.join(COMPANY_TAILS)}))+$", ""))


def canonical_member_key(c: Column) -> Column:
    """Accents, punctuation, honorifics and credentials off, neighbouring initials joined; missing markers are ''."""
    s = F.translate(F.upper(_text(c)), *ACCENTS)
    s = F.regexp_replace(s, "\\bPH\\.D\\.", "PHD")
    s = F.regexp_replace(s, "\\b([A-Z])\\.(?=[A-Z]\\.)", "$1")
    s = F.regexp_replace(s, "[^A-Z0-9 ]", " ")
    tokens = F.filter(F.split(s, " +"), lambda t: (t != "") & ~t.isin(*HONORIFICS))
    bare = F.concat(F.slice(tokens, 1, 1), F.filter(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: ~t.isin(*CREDENTIALS)))
    tokens = F.when(F.size(bare) >= 2, bare).otherwise(tokens)
    key = F.regexp_replace(F.array_join(tokens, " "), "(?<=\\b[A-Z]) (?=[A-Z]\\b)", "")
    return F.when(key.isin(*MISSING_MEMBERS), "").otherwise(key)


def chamber_member_key(chamber: Column, name: Column) -> Column:
    """A member's key within a chamber; missing names have none."""
    key = canonical_member_key(name)
    return F.when(key == "", "").otherwise(F.concat_ws(":", F.lower(chamber), key))


def actor_id(kind: Column, name: Column) -> Column:
    """Kind and name; only members of congress are folded further than case and blanks."""
    return F.concat(kind, F.lit(":"), F.when(kind == "congress", canonical_member_key(name)).otherwise(F.upper(clean_text(name))))


def normalize_ticker(c: Column) -> Column:
    """Trimmed upper case; missing markers are null."""
    s = F.upper(F.trim(c))
    return F.when((s == "") | s.isin(*MISSING_TICKERS), None).otherwise(s)


def is_valid_ticker(c: Column) -> Column:
    """An equity symbol by form, and no reserved word."""
    s = normalize_ticker(c)
    return F.coalesce(s.rlike(TICKER_FORM) & ~s.isin(*NON_EQUITY_TICKERS), F.lit(False))


def cusip_is_valid(c: Column) -> Column:
    """Nine characters, the last a check digit of the eight before it."""
    s = F.upper(F.trim(_text(c)))
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"

    def weight(i: int) -> Column:
        v = F.coalesce(F.array_position(F.split(F.lit(alphabet), ""), F.substring(s, i, 1)), F.lit(0)).cast("int") - 1
        v = v * (2 if i % 2 == 0 else 1)
        return F.floor(v / 10) + v % 10

    total = reduce(lambda a, b: a + b, [weight(i) for i in range(1, 9)])
    return s.rlike("^[0-9A-Z*@#]{8}[0-9]$") & (F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string") == F.substring(s, 9, 1))


def filed_lot(c: Column) -> Column:
    """Struct of shares and price from "n shares @ $p"."""
    p = "([0-9][0-9,]*(?:\\.[0-9]+)?)\\s+shares?\\s*(?:@|at)\\s*\\$\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)"
    s = F.lower(_text(c))
    number = lambda i: F.regexp_replace(F.nullif(F.regexp_extract(s, p, i), F.lit("")), ",", "").cast("double")
    return F.struct(number(1).alias("shares"), number(2).alias("price"))


def parse_source_family(c: Column) -> Column:
    """Parser text to the family of rows that it makes; the first that fits."""
    s = F.lower(_text(c))
    return F.when(s.like("%gemini%") | s.like("%ocr%"), "gemini_ocr").when(s.like("%house%") | s.like("%pdf%"), "house_pdf").when(s.like("%senate%"), "senate_efd").when(s.like("%form4%"), "form4").when(s.like("%13f%"), "13f").otherwise("unknown")


def disclosure_lag(transaction: Column, disclosure: Column) -> Column:
    """Days from trade to disclosure."""
    return F.datediff(disclosure, transaction)


def poisson_base_rate(n: Column, span_days: Column, window_days: Column) -> Column:
    """The chance of at least one of n events of a span in a random window."""
    return 1 - F.exp(-n / span_days * window_days)


def return_columns(entry: Column, exit_: Column, bench_entry: Column, bench_exit: Column, slippage_bps: float = 10.0) -> Column:
    """Struct of return, benchmark return and alpha in percent, slippage on both legs of both; not rounded."""
    up, down = 1 + slippage_bps / 10_000, 1 - slippage_bps / 10_000
    own = (exit_ * down / (entry * up) - 1) * 100
    bench = (bench_exit * down / (bench_entry * up) - 1) * 100
    return F.struct(own.alias("ret"), bench.alias("bench"), (own - bench).alias("alpha"))


def peak_potential(kind: Column, entry: Column, peak: Column, trough: Column, complete: Column) -> Column:
    """What a perfect exit would have made, in percent; null unless the window is complete."""
    return F.when(complete & (kind == "Purchase"), (peak / entry - 1) * 100).when(complete & (kind == "Sale"), (1 - trough / entry) * 100)


def kelly_fraction(p: Column, win: Column, loss: Column, part: float = 0.5) -> Column:
    """The stated part of the Kelly fraction for win chance p and mean win and loss; never negative."""
    b = win / loss
    return F.greatest((p * b - (1 - p)) / b, F.lit(0.0)) * part


def skill_weight(hits: Column, n: Column, prior: Column, strength: float = 20.0) -> Column:
    """Posterior mean hit rate, shrunk to the prior of the source."""
    return (hits + prior * strength) / (n + strength)


def evidence_decay(as_of: Column, disclosed: Column, half_life: float = 90.0) -> Column:
    """Halves every half-life; evidence older than two calendar months, or later than as_of, has none."""
    age = F.datediff(as_of, disclosed)
    return F.when((disclosed <= as_of) & (disclosed >= F.add_months(as_of, -2)), F.pow(F.lit(0.5), age / half_life))


def chronology_violations(transaction: Column, disclosure: Column, notification: Column, low: str = "1995-06-01", high: str = "2001-06-30") -> Column:
    """What is wrong with a row's dates, in this order."""
    return F.array_compact(
        F.array(
            F.when(transaction.isNull() | disclosure.isNull(), "missing_date"),
            F.when(transaction > disclosure, "trade_after_disclosure"),
            F.when(notification < transaction, "notification_before_trade"),
            F.when((transaction < F.lit(low).cast("date")) | (transaction > F.lit(high).cast("date")), "outside_domain"),
        )
    )


def row_fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns in the order given; null and '' differ."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns)), 256)


def classify_scan(chars: Column, dpi: Column) -> Column:
    """A page with text is not a scan; of scans, those under 200 dpi are low in resolution."""
    return F.when(chars > 200, "text_missed").when(dpi < 200, "low_resolution").otherwise("scanned")


def option_return_guard(instrument: Column) -> Column:
    """Stocks have leverage 1; returns of anything else are not priced, with the reason."""
    stock = F.lower(instrument) == "stock"
    return F.struct(F.when(stock, 1.0).alias("leverage"), F.when(~F.coalesce(stock, F.lit(False)), "unsupported_instrument_pricing").alias("reason"))


def snapshot_to_json(shares: Column, value: Column, as_of: Column) -> Column:
    """A share snapshot as JSON text, keys in this order."""
    return F.to_json(F.struct(shares.alias("shares"), value.alias("value"), as_of.cast("string").alias("as_of")))


def snapshot_from_json(c: Column) -> Column:
    """Struct of shares and reason; what is no object, or has no share count of zero or more, says why."""
    got = F.from_json(c, "shares double, value double, as_of string")
    reason = F.when(c.isNull() | ~F.trim(c).startswith("{"), "not_an_object").when(got["shares"].isNull(), "shares_missing").when(got["shares"] < 0, "shares_negative")
    return F.struct(F.when(reason.isNull(), got["shares"]).alias("shares"), reason.alias("reason"))


def json_field(c: Column, path: str) -> Column:
    """One named path out of JSON text; null where the text or the path is not there."""
    return F.get_json_object(c, path)


def row_rejection_reason(asset: Column, kind: Column, traded: Column, notified: Column, amount: Column, low: str, high: str) -> Column:
    """The first rule that an extracted row fails."""
    return (
        F.when(F.trim(F.coalesce(asset, F.lit(""))) == "", "asset")
        .when(normalize_transaction_type(kind).isNull(), "type")
        .when(traded.isNull(), "date")
        .when(notified < traded, "notification")
        .when(F.coalesce(amount, F.lit(0.0)) <= 0, "amount")
        .when(~traded.between(F.lit(low).cast("date"), F.lit(high).cast("date")), "out_of_window")
    )


def option_evidence(asset: Column) -> Column:
    """F8: positive evidence of an option: its code, or an option instrument without a stock code."""
    return F.coalesce(F.lower(asset).contains("[op]") | classify_instrument(asset).isin("call", "put", "option"), F.lit(False))


def cash_or_fund(symbol: Column) -> Column:
    """symbols that stand for cash or a fund."""
    return F.coalesce(F.upper(F.trim(symbol)).isin(*NON_EQUITY_TICKERS) | F.upper(symbol).rlike("CASH|FUND|MONEY"), F.lit(False))


def rule_reference(reference: Column, disclosed: Column, as_of: Column, blocked: Column, corroboration_only: Column) -> Column:
    """F16: struct of a usable entry reference, or the first reason why it is none."""
    reason = (
        F.when(blocked.isNotNull(), blocked).when(corroboration_only, "corroboration_only").when(reference.isNull() | F.isnan(reference) | (reference <= 0), "no_reference")
        .when((disclosed > as_of) | (disclosed < F.add_months(as_of, -2)), "too_old")
    )
    return F.struct(F.when(reason.isNull(), reference).alias("reference"), reason.alias("reason"))
