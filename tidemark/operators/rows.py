"""Row identity, versions and set operations: which row is current, which is a copy, what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["source", "chamber", "source_record_id", "source_row_id", "ingestion_generation"]
FILING = IDENTITY[:-1]
ECONOMIC = ["member", "ticker", "transaction_date", "transaction_type", "owner_code", "asset_description"]
FOREVER = "9999-12-31"


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def phantom_duplicates(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All but the first row of a key; nulls in a key are one value."""
    w = Window.partitionBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).orderBy(*order)
    return rows.withColumn("copy_number", F.row_number().over(w)).where("copy_number > 1")


def dedupe_identity(rows: DataFrame, order: Sequence[Column], identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Of rows with the same complete identity the first in ``order``; rows with a blank part all stay."""
    whole = F.lit(True)
    for c in identity:
        whole = whole & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    w = Window.partitionBy("__whole", *identity).orderBy(*order)
    return rows.withColumn("__whole", whole).withColumn("__n", F.row_number().over(w)).where("NOT __whole OR __n = 1").drop("__whole", "__n")


def flag_economic_duplicates(rows: DataFrame, key: Sequence[str] = ECONOMIC) -> DataFrame:
    """Marks rows that share the economic key, nulls included; drops none."""
    return rows.withColumn("economic_duplicate_candidate", F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1)


def collapse_episodes(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each episode, and how many rows it stands for."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"episode_rows": F.count(F.lit(1)).over(w), "__n": F.row_number().over(w.orderBy(*order))}).where("__n = 1").drop("__n")


def retain_terminal_runs(runs: DataFrame, keys: Sequence[str], terminal: Column, at: str, tie: str) -> DataFrame:
    """One run per identity; an unfinished attempt never replaces a finished one."""
    return latest_per_key(runs, keys, [F.desc(terminal.cast("int")), F.desc(at), F.desc(tie)])


def stratified_sample(rows: DataFrame, stratum: str, flag: str, id_col: str, k: int, seed: str) -> DataFrame:
    """K rows per stratum, flagged ones first, then by a hash of seed and id."""
    w = Window.partitionBy(stratum).orderBy(F.desc(F.col(flag).cast("int")), F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256), id_col)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def verify_hash_chain(lines: DataFrame, chain: str, order: str) -> DataFrame:
    """Lines whose previous_hash is not the hash of the line before (the first of a chain has none)."""
    before = F.lag("line_hash").over(Window.partitionBy(chain).orderBy(order))
    return lines.withColumn("expected", before).where(~F.col("previous_hash").eqNullSafe(F.col("expected"))).select(chain, order, "previous_hash", "expected")


def order_identity(rows: DataFrame, partition: Sequence[str]) -> DataFrame:
    """The place of each row in the total order of trades within a partition, nulls first."""
    keys = ["transaction_date", "disclosure_date", "source", "source_record_id", "source_row_id", "owner_code", "part_key", "supp_key", "amount_midpoint"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*(F.asc_nulls_first(k) for k in keys))))


def union_versions(current: DataFrame, retired: DataFrame) -> DataFrame:
    """Current rows and retired versions, by name; current ones have no retire time."""
    return current.unionByName(retired, allowMissingColumns=True)


def as_of_rows(versions: DataFrame, end_of_day: Column) -> DataFrame:
    """Versions visible at the end of a day."""
    return versions.where((F.col("created_at") < end_of_day) & (F.col("retired_at").isNull() | (F.col("retired_at") >= end_of_day)))


def row_version_history(versions: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Each version with the time that it was replaced."""
    return versions.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*key).orderBy(at)))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows of before that after does not have."""
    return before.subtract(after)


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows each side has over the other, as multisets."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_in_a"))
    return left.crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_in_b")))


def merge_append_only(stored: DataFrame, new: DataFrame, key: Sequence[str] = FILING) -> DataFrame:
    """U4: stored rows as they are, and new ones whose key is not stored; null keys match null keys."""
    known = stored.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
    match = F.lit(True)
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return stored.unionByName(new.join(known, match, "left_anti"))


def merge_chunks(chunks: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Per key the number of rows and of different contents over all chunks; conflicts have more than one."""
    rows = chunks[0]
    for c in chunks[1:]:
        rows = rows.unionByName(c)
    content = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(content).alias("contents")).withColumn("conflict", F.col("contents") > 1)


def multiset_subset(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more often in a than in b."""
    n = a.groupBy(*key).agg(F.count(F.lit(1)).alias("n_a"))
    m = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n_b"))
    return n.join(m, list(key), "left").withColumn("n_b", F.coalesce("n_b", F.lit(0))).where("n_a > n_b")


def common_dates(a: DataFrame, b: DataFrame, date: str) -> DataFrame:
    """U8: dates on both sides."""
    return a.select(date).intersect(b.select(date))


def upsert_by_identity(stored: DataFrame, new: DataFrame, mutable: Sequence[str], identity: Sequence[str] = IDENTITY) -> DataFrame:
    """New rows come in; of known ones mutable fields take the new value, others only where they were null."""
    others = [c for c in stored.columns if c not in identity and c not in mutable]
    fresh = new.select(*identity, *(F.col(c).alias(f"__{c}") for c in [*mutable, *others]), F.lit(True).alias("__new"))
    both = stored.withColumn("__old", F.lit(True)).join(fresh, list(identity), "full_outer")
    cols = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in mutable] + [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in others]
    state = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new"), "updated").otherwise("kept")
    return both.select(*identity, *cols, state.alias("change"))


def drop_already_stored(stored: DataFrame, new: DataFrame, key: Sequence[str] = FILING) -> DataFrame:
    """New rows with a whole identity, once each, that are not stored; identities compare trimmed, in lower case."""
    clean = lambda df: [F.lower(F.trim(F.col(k).cast("string"))).alias(f"__{k}") for k in key]
    names = [f"__{k}" for k in key]
    one = new.select("*", *clean(new)).where(" AND ".join(f"{n} IS NOT NULL AND {n} <> ''" for n in names))
    one = latest_per_key(one, names, [F.asc(c) for c in new.columns])
    return one.join(stored.select(*clean(stored)).distinct(), names, "left_anti").drop(*names)


def replace_documents(stored: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of the documents in ``new`` are replaced, all others stay."""
    return stored.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)


def upsert_last_wins(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key; the new side wins."""
    both = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    return latest_per_key(both, key, [F.asc("__age"), *(F.asc(c) for c in old.columns if c not in key)]).drop("__age")


def retire_removed_documents(rows: DataFrame, archive: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of documents that left the archive, each as JSON, with the reason."""
    gone = rows.join(archive.select(doc).distinct(), doc, "left_anti")
    return gone.select(doc, F.to_json(F.struct("source_row_id", "ticker")).alias("row_json"), F.lit("removed_from_archive").alias("reason"))


def duplicate_identities(rows: DataFrame, key: Sequence[str] = IDENTITY) -> DataFrame:
    """Keys that occur more than once, nulls included, with how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_after_merge(source: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of the source that the target lacks."""
    return source.select(*key).distinct().join(target.select(*key).distinct(), list(key), "left_anti")


def drop_superseded(rows: DataFrame, record: str, amends: str) -> DataFrame:
    """Rows without those whose record a later row amends."""
    return rows.join(rows.where(F.col(amends).isNotNull()).select(F.col(amends).alias(record)).distinct(), record, "left_anti")


def violation_preview(violations: DataFrame, rule: str, order: Sequence[str], most: int = 25) -> DataFrame:
    """K6: the first rows of each rule and how many there are in all."""
    w = Window.partitionBy(rule)
    return violations.withColumns({"total": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy(*order))}).where(F.col("place") <= most)


def read_transactions(rows: DataFrame, year: int | None = None, between: tuple[str, str] | None = None, sources: Sequence[str] = (), doc: str | None = None) -> DataFrame:
    """Canonical rows of a disclosure year, a range of days, sources or a document; conditions that reach the scan."""
    out = rows
    if year is not None:
        out = out.where(F.col("disclosure_date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))
    if between is not None:
        out = out.where(F.col("disclosure_date").between(*(F.lit(x).cast("date") for x in between)))
    if sources:
        out = out.where(F.col("source").isin(*sources))
    return out if doc is None else out.where(F.col("doc_id") == doc)


def read_skill_history(rows: DataFrame, pairs: DataFrame, before: Column) -> DataFrame:
    """Rows of the listed (source, member) pairs disclosed before a day."""
    return rows.where(F.col("disclosure_date") < before).join(pairs.select("source", "member").distinct(), ["source", "member"], "left_semi")


def replace_archive(stored: DataFrame, archive: DataFrame, key: str = "doc_id") -> DataFrame:
    """T4: what becomes of each index row when an archive replaces another: inserted, updated, same or deleted."""
    cols = [c for c in archive.columns if c != key]
    a = stored.select(key, F.struct(*cols).alias("__old")).dropDuplicates([key])
    b = archive.select(key, F.struct(*cols).alias("__new")).dropDuplicates([key])
    state = F.when(F.col("__new").isNull(), "deleted").when(F.col("__old").isNull(), "inserted").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, state.alias("change"), *(F.col("__new")[c].alias(c) for c in cols))


def served_state(state: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The served generation of each ticker: a new verdict replaces the pointer; one that is not comparable keeps the generation."""
    both = state.select("ticker", F.col("served").alias("__was"), F.col("comparable").alias("__c")).join(verdicts.select("ticker", F.col("generation").alias("__now"), F.col("comparable").alias("__ok")), "ticker", "full_outer")
    served = F.when(F.col("__ok"), F.col("__now")).otherwise(F.coalesce("__was", "__now"))
    return both.select("ticker", served.alias("served"), F.coalesce("__ok", "__c").alias("comparable"), F.col("__was").isNull().alias("inserted"))
