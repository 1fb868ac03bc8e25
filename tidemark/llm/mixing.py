"""Mixing sources to target weights: temperature by bisection, then budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BISECTIONS = 60
#: Hex digits of a block's name: 4,096 blocks a source; and of its place in a pass, which the permutation key begins with.
BLOCK_DIGITS, BLOCK_PLACE = 3, 12
WORDS = "[^\\x20\\x09-\\x0D]+"


def block_of(source: Column, doc_id: Column) -> Column:
    """The block of its source that a document is dealt to, the same in every pass; an md5, which other engines give too."""
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, BLOCK_DIGITS)


def permutation_key(seed: int, turn: Column, source: Column, doc_id: Column) -> Column:
    """The place of a document in the given pass over its source: the place of its block in this pass, then its own in the block."""
    place = lambda x, n: F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), turn.cast("string"), F.coalesce(source, F.lit("")), x)), 1, n)
    return F.concat(place(block_of(source, doc_id), BLOCK_PLACE), place(F.coalesce(doc_id.cast("string"), F.lit("")), 24))


def _sum(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))


def _entropy(shares: Column, exponent: Column) -> Column:
    total = _sum(shares, lambda p: F.pow(p, exponent))
    return _sum(shares, lambda p: -(F.pow(p, exponent) / total) * F.log(F.pow(p, exponent) / total))


def _most_passes(shares: Column, exponent: Column, budget: Column | None, tokens: Column) -> Column:
    """Passes over the source that is repeated most; without a budget the largest source has exactly one."""
    if budget is None:
        return F.pow(F.array_min(shares) / F.array_max(shares), exponent - 1)
    total = _sum(shares, lambda p: F.pow(p, exponent))
    return F.array_max(F.transform(shares, lambda p: F.pow(p, exponent) / total * budget / (p * tokens)))


def source_plan(sizes: DataFrame, *, max_passes: float | None = None, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """Weights, token budgets and passes per source, from (source, tokens).

    A source's weight is its token share to a power between 0 (all alike) and 1 (as they are), normalised. The
    exponent is bisected to the given ``entropy`` (in nats), or to the smallest one that repeats no source
    more than ``max_passes`` times. ``budget``: tokens to be given out; by default as many as give the source
    with the most tokens exactly one pass, so that no source gets less. A target out of reach gives the end
    of the range that is nearest. Sources without tokens get one pass.
    """
    if (max_passes is None) == (entropy is None):
        raise ValueError("either max_passes or entropy")
    given = F.lit(float(budget)) if budget is not None else None
    one = sizes.where("tokens > 0").agg(F.sum("tokens").cast("double").alias("total"), F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("sizes"))
    one = one.withColumn("shares", F.transform("sizes", lambda t: t / F.col("total")))

    def too_even(mid: Column) -> Column:
        if entropy is not None:
            return _entropy(F.col("shares"), mid) > entropy
        return _most_passes(F.col("shares"), mid, given, F.col("total")) > max_passes

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        return F.struct(F.when(too_even(mid), mid).otherwise(state["lo"]).alias("lo"), F.when(too_even(mid), state["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    one = one.withColumn("exponent", F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)["hi"])
    one = one.withColumn("norm", _sum(F.col("shares"), lambda p: F.pow(p, F.col("exponent"))))
    tokens = given if given is not None else F.col("total") * F.array_max("shares") * F.col("norm") / F.pow(F.array_max("shares"), F.col("exponent"))
    one = one.select("total", "exponent", "norm", tokens.alias("given"))
    plan = sizes.join(F.broadcast(one), F.lit(True), "left").withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("norm")).otherwise(0.0))
    plan = plan.withColumn("budget", F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.col("given")).cast("long")).otherwise(0))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")).cast("int")).otherwise(1)
    return plan.select("source", "tokens", "weight", "exponent", "budget", full.alias("full_passes"), F.when(F.col("tokens") > 0, F.col("budget") - full.cast("long") * F.col("tokens")).otherwise(0).alias("left_over"))


def _cut_offs(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Per source: how far its last, partial pass goes, as the place of a block in this pass and the last key taken in it.

    Prefix sums in two levels: sums of blocks first, then the keys of the one block per source where the
    left-over ends. No window holds more than the block sums of a source or the rows of a block.
    """
    turn = F.col("full_passes") + 1
    keyed = slim.join(F.broadcast(plan.where("left_over > 0").select("source", "full_passes", "left_over")), slim.source.eqNullSafe(plan.source)).select(slim.source, "doc_id", "tokens", "left_over", permutation_key(seed, turn, slim.source, F.col("doc_id")).alias("key"))
    keyed = keyed.groupBy("source", "left_over", "key").agg(F.sum("tokens").alias("tokens")).withColumn("block", F.substring("key", 1, BLOCK_PLACE))
    sums = keyed.groupBy("source", "left_over", "block").agg(F.sum("tokens").alias("n"))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(by_block))
    edge = sums.where("upto > left_over").groupBy("source").agg(F.min_by(F.struct("block", (F.col("upto") - F.col("n")).alias("before")), "block").alias("e")).select(F.col("source").alias("s"), "e.block", "e.before")
    inside = keyed.join(F.broadcast(edge), keyed.source.eqNullSafe(edge.s) & (keyed.block == edge.block)).select("source", keyed.block, "key", "tokens", "before", "left_over")
    by_key = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(by_key))
    last = inside.groupBy("source", "block").agg(F.max(F.when(F.col("upto") <= F.col("left_over"), F.col("key"))).alias("last_key"))
    return last.select("source", F.col("block").alias("edge_block"), "last_key")


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.alias("tokens"))


def mix_sources(docs: DataFrame, *, max_passes: float | None = None, entropy: float | None = None, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Repeat and cut sources to their target weights: the rows of ``docs``, once for each pass that takes them.

    Tokens are words of the whole text. ``source_plan`` gives each source full passes and a left-over. The documents
    of a source are dealt to blocks; every pass has its own permutation of the blocks, and of the documents
    in each; the last pass takes whole blocks in its order, then documents of one more, while they fit into the
    left-over. Added columns: mix_pass (from 1), mix_block (which stays with a document) and mix_key, whose
    order within a pass is the permuted one, over all sources; existing columns of these names are replaced. Rows
    stay where they are; ``in_mixed_order`` lays them out.

    Null or empty text: no tokens. Null source: a source of its own. Rows without an id share one place in
    the order; repeated rows of an id go together, and are taken only if all fit. An empty table gives none.
    The texts are never shuffled: they meet one row per source, whose number must be at most 100,000.
    """
    slim = stored(token_counts(docs, id_col, text_col, source_col), "mix-tokens")
    sizes = stored(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sizes")
    if sizes.count() > 100_000:
        raise ValueError("more than 100,000 sources")
    plan = stored(source_plan(sizes, max_passes=max_passes, entropy=entropy, budget=budget), "mix-plan")
    cuts = _cut_offs(slim, plan, seed)
    rule = stored(plan.join(cuts, plan.source.eqNullSafe(cuts.source), "left").select(plan.source.alias("__source"), "full_passes", "left_over", "edge_block", "last_key"), "mix-rule")
    names = [c for c in docs.columns if c not in ("mix_pass", "mix_block", "mix_key")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    source = F.col(f"`{source_col}`").cast("string")
    turns = F.explode(F.sequence(F.lit(1), F.col("full_passes") + F.when(F.col("left_over") > 0, 1).otherwise(0)))
    some = (F.col("full_passes") > 0) | (F.col("left_over") > 0)
    placed = rows.join(F.broadcast(rule), source.eqNullSafe(F.col("__source"))).where(some).withColumn("mix_pass", turns)
    placed = placed.withColumn("mix_key", permutation_key(seed, F.col("mix_pass"), source, F.col(f"`{id_col}`").cast("long"))).withColumn("mix_block", block_of(source, F.col(f"`{id_col}`").cast("long")))
    place = F.substring("mix_key", 1, BLOCK_PLACE)
    fits = (place < F.col("edge_block")) | ((place == F.col("edge_block")) & (F.col("mix_key") <= F.col("last_key")))
    taken = placed.where((F.col("mix_pass") <= F.col("full_passes")) | F.coalesce(fits, F.col("edge_block").isNull()))
    return taken.select(*(F.col(f"`{c}`") for c in names), "mix_pass", "mix_block", "mix_key")


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix_sources`` laid out by pass and permuted block, ranges over tasks: one shuffle of the texts."""
    return mixed.repartitionByRange("mix_pass", "mix_key").sortWithinPartitions("mix_pass", "mix_key")
