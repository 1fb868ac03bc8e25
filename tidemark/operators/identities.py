"""Who a name stands for: variants of members' names, and companies in asset descriptions."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_member_key, normalize_company_name
from .lineage import written_once

# Fixed values.
NICKNAMES = {
    "BOB": "ROBERT", "BILL": "WILLIAM", "JIM": "JAMES", "MIKE": "MICHAEL", "TOM": "THOMAS", "DAVE": "DAVID", "DAN": "DANIEL", "STEVE": "STEVEN",
    "JOE": "JOSEPH", "MATT": "MATTHEW", "NICK": "NICHOLAS", "ALEX": "ALEXANDER", "CHRIS": "CHRISTOPHER", "PAT": "PATRICK", "TIM": "TIMOTHY",
    "JEFF": "JEFFREY", "GREG": "GREGORY", "RON": "RONALD", "KEN": "KENNETH", "LARRY": "LAWRENCE", "RICK": "RICHARD", "CHUCK": "CHARLES", "RO": "ROHIT",
    "HAL": "HAROLD", "DICK": "RICHARD", "NED": "EDWARD", "TED": "THEODORE",
}
UNRESOLVABLE = ["TREASURY", "T BILL", "T NOTE", "SWEEP", "MONEY MARKET", "MUTUAL FUND", "INDEX FUND", "INVESTMENT FUND", "ETF", "ETN", "FUND", "CASH", "BOND", "NOTE", "MTN", "FD"]
#: Names of a dictionary that every task may hold as an automaton.
MOST_NAMES = 200_000
# Fixed values.
ALIASES = {
    "ZOETIS": "ZTS", "BIO TECHNE": "TECH", "DENNYS": "DENN", "VISHAY PRECISION GROUP": "VPG", "BANK OF AMERICA": "BAC", "AXALTA COATING SYSTEMS": "AXTA", "PAR PETROLEUM": "PARR",
    "MICRON TECHNOLOGY": "MU", "DOORDASH": "DASH", "GE HEALTHCARE": "GEHC", "ALLSTATE": "ALL", "AMAZON": "AMZN", "URBAN OUTFITTERS": "URBN", "CTS CORP": "CTS", "ABBOTT LABORATORIES": "ABT",
    "BOOKING HOLDINGS": "BKNG", "AMERICAN TOWER": "AMT", "SHERWIN WILLIAMS": "SHW", "FEDERAL SIGNAL": "FSS", "LOWES": "LOW", "REGENERON PHARMACEUTICALS": "REGN", "BAXTER INTERNATIONAL": "BAX",
    "PFIZER": "PFE", "COMCAST": "CMCSA", "DANAHER": "DHR", "INTUITIVE SURGICAL": "ISRG", "GENERAL MOTORS": "GM", "SCHLUMBERGER": "SLB", "ELANCO ANIMAL HEALTH": "ELAN", "LINDE": "LIN",
    "TAKE TWO INTERACTIVE": "TTWO", "ANTERO MIDSTREAM": "AM", "QUALCOMM": "QCOM", "CVS HEALTH": "CVS", "FIDELITY NATIONAL INFORMATION": "FIS", "INTUIT": "INTU", "WALMART": "WMT", "NETFLIX": "NFLX",
    "TESLA": "TSLA", "SALESFORCE": "CRM", "UNION PACIFIC": "UNP", "PLAINS ALL AMERICAN PIPELINE": "PAA", "MERCK & CO": "MRK", "UNITEDHEALTH GROUP": "UNH", "JOHNSON & JOHNSON": "JNJ",
    "COGNIZANT TECHNOLOGY SOLUTIONS": "CTSH", "CATERPILLAR": "CAT", "VISA": "V", "JPMORGAN CHASE": "JPM",
}


def _same_first(a: Column, b: Column) -> Column:
    full = F.create_map(*(F.lit(x) for kv in NICKNAMES.items() for x in kv))
    return (a == b) | F.coalesce(full[a] == b, F.lit(False)) | F.coalesce(full[b] == a, F.lit(False))


def same_member(a: Column, b: Column) -> Column:
    """Two canonical keys, as arrays of tokens with the same last one, may be one person: first names alike, middle ones not in conflict."""
    first_a, first_b = F.get(a, F.lit(0)), F.get(b, F.lit(0))

    def middle(x: Column) -> Column:
        return F.filter(F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0))), lambda t: ~(_same_first(first_a, t) | _same_first(first_b, t)))

    ma, mb = middle(a), middle(b)
    alike = lambda x, y: (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))
    free = (F.size(ma) == 0) | (F.size(mb) == 0) | ((F.size(ma) == F.size(mb)) & F.forall(F.zip_with(ma, mb, alike), lambda t: t))
    return (F.size(a) > 1) & (F.size(b) > 1) & _same_first(first_a, first_b) & free


def member_identity_groups(keys: DataFrame) -> DataFrame:
    """(key, identity) of distinct canonical keys: the alphabetically first of the variants of a person, '' if ambiguous.

    A variant that matches two keys which do not match each other is ambiguous and joins nobody. Variants left
    match each other pairwise, so a person's group is a key and its matches: no search over links is needed.
    Keys meet by surname; a surname's distinct keys are few, whatever the number of rows.
    """
    names = keys.select("key").where("key <> ''").distinct().withColumn("tokens", F.split("key", " ")).withColumn("surname", F.element_at("tokens", -1))
    a, b = (names.select("surname", F.col("key").alias(k), F.col("tokens").alias(t)) for k, t in (("a", "ta"), ("b", "tb")))
    pairs = a.join(b, "surname").where((F.col("a") < F.col("b")) & same_member(F.col("ta"), F.col("tb"))).select("a", "b")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    peers = both.select(F.col("a").alias("key"), F.col("b").alias("p")).join(both.select(F.col("a").alias("key"), F.col("b").alias("q")), "key").where("p < q")
    split = peers.join(pairs.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"], "left_anti").select("key").distinct().withColumn("__split", F.lit(True))
    sure = both.join(split.select(F.col("key").alias("b")), "b", "left_anti").groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least"))
    out = names.select("key").join(split, "key", "left").join(sure, "key", "left")
    return out.select("key", F.when(F.col("__split"), "").otherwise(F.least("key", F.coalesce("least", "key"))).alias("identity"))


def same_actor(a: Column, b: Column) -> Column:
    """Two canonical keys, as arrays of tokens, may be one initiator: the same last name, first names alike, middle names equal or missing."""
    middle = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0)))
    free = (F.size(middle(a)) == 0) | (F.size(middle(b)) == 0) | (middle(a) == middle(b))
    return (F.size(a) > 1) & (F.size(b) > 1) & (F.element_at(a, -1) == F.element_at(b, -1)) & _same_first(F.get(a, F.lit(0)), F.get(b, F.lit(0))) & free


def actor_representatives(actors: DataFrame) -> DataFrame:
    """(actor, representative) of distinct actors, told in order: each takes the first representative before it that may be the same person, or becomes one.

    ``actors``: actor (kind:name), place (their order, distinct) and open (actors of open positions, which come first and are all representatives). The
    rule is sequential, as likeness is not transitive; it is worked in rounds, each of which settles all actors that have no unsettled
    likeness before them. Only members of congress meet, by surname, and what is joined are pairs of alike actors.
    """
    a = actors.select("actor", "place", "open", F.substring_index("actor", ":", 1).alias("kind"), canonical_member_key(F.substring_index("actor", ":", -1)).alias("key"))
    a = a.withColumn("tokens", F.split("key", " ")).withColumn("surname", F.when((F.col("kind") == "congress") & (F.col("key") != ""), F.element_at("tokens", -1)))
    x, y = (a.where("surname IS NOT NULL").select("surname", *(F.col(c).alias(f"{c}_{n}") for c in ("actor", "place", "open", "key", "tokens"))) for n in ("a", "b"))
    alike = (F.col("key_a") == F.col("key_b")) | same_actor(F.col("tokens_a"), F.col("tokens_b"))
    pairs = written_once(x.join(y, "surname").where((F.col("place_b") < F.col("place_a")) & ~(F.col("open_a") & F.col("open_b")) & alike).select("actor_a", "actor_b", "place_b"))
    settled = written_once(a.join(pairs.select(F.col("actor_a").alias("actor")).distinct(), "actor", "left_anti").union(a.where("open")).select("actor", F.col("actor").alias("representative")).distinct())
    left = written_once(pairs.join(settled.select(F.col("actor").alias("actor_a")), "actor_a", "left_anti"))
    while not left.isEmpty():
        known = left.join(settled.select(F.col("actor").alias("actor_b"), "representative"), "actor_b", "left")
        own = F.when(F.col("representative") == F.col("actor_b"), F.struct("place_b", "representative"))
        ready = known.groupBy("actor_a").agg(F.bool_and(F.col("representative").isNotNull()).alias("ready"), F.min(own).alias("first")).where("ready")
        settled = written_once(settled.union(ready.select("actor_a", F.coalesce("first.representative", "actor_a"))))
        left = written_once(left.join(ready.select("actor_a"), "actor_a", "left_anti"))
    return settled


def coalesce_actors(events: DataFrame, open_actors: DataFrame, actor: str, seen: str, spelling: str) -> DataFrame:
    """Events with the identity of their actor and its most informative spelling (tokens, length, then name); the own actor stays.

    ``open_actors``: actor of open positions, taken in the order of their names; then come the actors of events by their least ``seen``.
    """
    first = events.groupBy(F.col(actor).alias("actor")).agg(F.min(seen).alias("seen"))
    both = first.join(open_actors.select("actor").distinct().withColumn("open", F.lit(True)), "actor", "full_outer").where("actor IS NOT NULL").withColumn("open", F.coalesce("open", F.lit(False)))
    place = F.struct(~F.col("open"), F.when(F.col("open"), F.col("actor")).otherwise(F.lit("")), F.when(~F.col("open"), F.col("seen")), F.col("actor"))
    groups = actor_representatives(both.select("actor", place.alias("place"), "open"))
    spelt = events.select(F.col(actor).alias("actor"), F.col(spelling).alias("spelling")).where("spelling IS NOT NULL").distinct().join(groups, "actor")
    best = spelt.groupBy("representative").agg(F.max_by("spelling", F.struct(F.size(F.split("spelling", " ")), F.length("spelling"), F.col("spelling"))).alias("display"))
    known = groups.join(best, "representative", "left").select(F.col("actor").alias(actor), F.col("representative").alias("identity"), "display")
    return events.join(known, actor, "left").withColumn("display", F.coalesce("display", spelling))


def _named_by_automaton(t: DataFrame, names: list[tuple[str, list[str]]]) -> DataFrame:
    """(text, found, symbol) of normalised texts: every name that lies in a text is told in one reading of it; names inside longer ones fall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ahocorasick.Automaton()
        for name, symbols in names:
            tree.add_word(f" {name} ", (len(name) + 2, symbols))
        if names:
            tree.make_automaton()
        for batch in batches:
            found, out = [], []
            for norm in batch.column("norm").to_pylist():
                spans = [(end - n, end, symbols) for end, (n, symbols) in tree.iter(f" {norm} ")] if names else []
                spans.sort(key=lambda s: (s[0], -s[1]))
                symbols, reach = set(), -1
                for _, end, of in spans:  # from the left, longer first: what ends no later than one before it lies inside it
                    if end > reach:
                        symbols.update(of)
                        reach = end
                found.append(bool(spans))
                out.append(symbols.pop() if len(symbols) == 1 else None)
            yield pa.record_batch([batch.column("text"), pa.array(found), pa.array(out, pa.string())], ["text", "found", "symbol"])

    return t.select("text", "norm").mapInArrow(run, "text string, found boolean, symbol string")


def _named_by_joins(t: DataFrame, c: DataFrame) -> DataFrame:
    """The same for dictionaries of any size: names meet texts by their first word and place."""
    at = t.select("text", "words", F.posexplode("words").alias("at", "word"))
    n = F.size("parts")
    met = at.join(c.withColumn("word", F.get("parts", F.lit(0))), "word").where(F.slice("words", F.col("at") + 1, n) == F.col("parts"))
    spans = met.groupBy("text", "at", (F.col("at") + n).alias("end")).agg(F.collect_set("symbol").alias("symbols")).groupBy("text").agg(F.collect_list(F.struct("at", "end", "symbols")).alias("s"))
    inside = lambda x, o: (o["at"] <= x["at"]) & (x["end"] <= o["end"]) & ((o["at"] != x["at"]) | (o["end"] != x["end"]))
    open_ = F.filter("s", lambda x: ~F.exists("s", lambda o: inside(x, o)))
    symbols = F.array_distinct(F.flatten(F.transform(open_, lambda x: x["symbols"])))
    return spans.select("text", F.lit(True).alias("found"), F.when(F.size(symbols) == 1, symbols[0]).alias("symbol"))


def match_company_names(texts: DataFrame, companies: DataFrame, aliases: dict[str, str] = ALIASES, most_names: int = MOST_NAMES) -> DataFrame:
    """(text, symbol) of distinct asset texts: the one symbol whose company is named in it, else null.

    ``companies``: (name, symbol), names normalised; ``aliases`` are further names. Account and custodian remarks are taken off
    a text first. A name inside a longer one that matched there does not count. Without any name in the text, words of four letters
    and more may each begin the words of one company (not of an alias). Up to ``most_names`` names, counted, are one automaton in every
    task; more meet the texts by joins. Abbreviations meet by the number of words and first four letters.
    """
    spark = texts.sparkSession
    bare = F.regexp_replace("text", "(?i)\\s*\\[\\s*(?:ACCOUNT|CUSTODIAN)\\s*[:=][^\\]]*\\]|\\s*\\(\\s*(?:ACCOUNT|CUSTODIAN)\\s*[:=][^)]*\\)|(?:^|\\s+)(?:ACCOUNT|CUSTODIAN)\\s*[:=].*$", "")
    t = texts.select("text").where("text IS NOT NULL").distinct().withColumn("norm", normalize_company_name(bare)).where("norm <> ''")
    barred = F.col("norm").rlike("\\b(?:" + "|".join(UNRESOLVABLE) + ")S?\\b") | (F.col("norm") == "JT")
    t = t.where(~barred).withColumn("words", F.split("norm", " "))
    c = companies.select("name", "symbol").where("name <> ''").distinct().withColumn("parts", F.split("name", " "))
    more = spark.createDataFrame(list(aliases.items()) or [("", "")], "name string, symbol string").where("name <> ''").select(normalize_company_name(F.col("name")).alias("name"), "symbol")
    every = c.select("name", "symbol").union(more).groupBy("name").agg(F.collect_set("symbol").alias("symbols"))
    few = every.limit(most_names + 1).collect()
    named = _named_by_automaton(t, [(r.name, r.symbols) for r in few]) if len(few) <= most_names else _named_by_joins(t, every.select("name", F.explode("symbols").alias("symbol")).withColumn("parts", F.split("name", " ")))
    named = written_once(named.where("found").select("text", "symbol"))
    rest = t.join(named.select("text"), "text", "left_anti").where(F.forall("words", lambda w: F.length(w) >= 4))
    head = lambda x: F.concat_ws(":", F.size(x), F.substring(F.get(x, F.lit(0)), 1, 4))
    begun = rest.withColumn("h", head(F.col("words"))).join(c.withColumn("h", head(F.col("parts"))), "h")
    begun = begun.where(F.forall(F.zip_with("words", "parts", lambda w, p: p.startswith(w)), lambda x: x)).groupBy("text").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol"))
    short = begun.select("text", F.when(F.col("n") == 1, F.col("symbol")).alias("symbol"))
    return texts.select("text").distinct().join(named.union(short), "text", "left")


def backfill_tickers(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows without a ticker take the one named in their description, with that origin; others stay."""
    found = match_company_names(rows.where("ticker IS NULL").select(F.col("asset_description").alias("text")), companies).select(F.col("text").alias("__text"), F.col("symbol").alias("__symbol"))
    out = rows.join(found, rows.ticker.isNull() & (rows.asset_description == found["__text"]), "left")
    origin = F.when(F.col("ticker").isNull() & F.col("__symbol").isNotNull(), "resolved_asset_name").otherwise(F.col("ticker_origin"))
    return out.withColumns({"ticker_origin": origin, "ticker": F.coalesce("ticker", "__symbol")}).drop("__text", "__symbol")


def clean_symbols(rows: DataFrame, prefixes: DataFrame, key: list[str]) -> DataFrame:
    """Names that stand where a symbol should: the symbol of the longest prefix known; rows that then repeat another go;
    words for cash and funds become null; what matches nothing stays.

    Names are taken in their order: a row goes if a row of the symbol, or of an earlier name of that symbol, has its key; a key with a null repeats
    nothing. ``prefixes``: (name, symbol), a small dictionary that distinct symbols meet by their first four letters.
    """
    wrong = rows.select("ticker").where(F.col("ticker").isNotNull() & ~F.col("ticker").rlike("^[A-Z]{1,5}(\\.[AB])?$") & (F.length("ticker") > 5)).distinct()
    up = wrong.withColumn("u", F.upper("ticker"))
    head = lambda c: F.substring(c, 1, 4)
    met = up.withColumn("h", head(F.col("u"))).join(prefixes.withColumn("h", head(F.col("name"))), "h").where(F.col("u").startswith(F.col("name")))
    best = met.groupBy("ticker").agg(F.max_by("symbol", F.struct(F.length("name"), F.col("symbol"))).alias("__to"))
    cash = up.where("u RLIKE 'CASH|FUND|MONEY'").select("ticker").join(best, "ticker", "left_anti").select("ticker", F.lit(True).alias("__null"))
    out = rows.join(best, "ticker", "left").join(cash, "ticker", "left")
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    out = out.withColumns({"__symbol": F.coalesce("__to", "ticker"), "__name": F.when(F.col("__to").isNotNull(), F.col("ticker")).otherwise("")})
    claims = out.where(whole & F.col("__symbol").isNotNull()).join(best.select(F.col("__to").alias("__symbol")).distinct(), "__symbol", "left_semi")
    first = claims.groupBy("__symbol", *key).agg(F.min("__name").alias("__first"))
    kept = out.join(first, ["__symbol", *key], "left").where(F.col("__to").isNull() | F.col("__first").isNull() | (F.col("__first") == F.col("__name")))
    new = F.when(F.col("__to").isNotNull(), F.col("__to")).when(F.col("__null"), None).otherwise(F.col("ticker"))
    return kept.withColumn("ticker", new).select(*rows.columns)
