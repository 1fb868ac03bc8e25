"""What the operators of this subpackage share: scratch tables, arrow loops, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and holds at most this many ids (16 MB of longs).
BROADCAST_IDS = 1_000_000
BATCH_ROWS = 1000
#: A key is hot if it has more rows than these and more than that share of all rows: there are at most HOT_KEYS such keys.
HOT_ROWS, HOT_KEYS = 10_000, 20_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; without one there is nothing that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, if they were not told by PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` rows: texts are long, and a batch is held on both sides."""
    importable(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def small_or_shuffled(ids: DataFrame) -> DataFrame:
    """A stored id table, marked for broadcast if its counted size is within the bound, else left to a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def hot_bound(rows: int) -> int:
    """Rows of a key from which it is hot, in a table of so many rows; at most ``HOT_KEYS`` keys are."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: str | list[str], count: str, total: int, bound: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``: one row per value of ``keys`` (longs) and its number of ``rows`` in ``count``.

    Hot keys (more than ``bound`` rows; see ``hot_bound`` of the ``total`` number of rows) meet their rows by a
    broadcast of at most ``HOT_KEYS`` rows and are spread over all tasks; the others meet by a shuffle, as all do
    where the table is too small to have a hot key. ``count`` is left out of the result. Null keys match nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    names = [c for c in per_key.columns if c not in (*keys, count)]
    bound = hot_bound(total) if bound is None else bound
    if total <= bound:
        return rows.join(per_key.drop(count), keys).select(*(F.col(f"`{c}`") for c in [*rows.columns, *names]))
    side = lambda where, n: per_key.where(where).select(*(F.col(k).alias(f"__{n}{i}") for i, k in enumerate(keys)), F.struct(*names).alias(f"__{n}"))
    hot, cold = side(F.col(count) > bound, "hot"), side(F.col(count) <= bound, "cold")
    out = rows.where(F.col(keys[0]).isNotNull()).join(F.broadcast(hot), [F.col(k) == F.col(f"__hot{i}") for i, k in enumerate(keys)], "left")
    # A hot row's key is replaced by a hash of the row, so that it goes to any task; what it meets there doesn't count.
    spread = F.when(F.col("__hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    match = [F.col("__spread") == F.col("__cold0"), *(F.col(k) == F.col(f"__cold{i}") for i, k in enumerate(keys) if i)]
    out = out.withColumn("__spread", spread).join(cold, match, "left").where("__hot IS NOT NULL OR __cold IS NOT NULL")
    found = F.coalesce("__hot", "__cold")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(found[c].alias(c) for c in names))


def bucket_of(column: Column | str, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``: the held-out split of the labelled operators."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(by))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Wrap a function of one arrow batch for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return run


def connected_components(links: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every linked node, by alternating large-star and small-star.

    ``links``: undirected (a, b) pairs of longs, repeats and loops allowed, nulls ignored. Returns
    (node, component) for every node with a link to another node. Each half-step is two shuffles of the
    remaining edges, written to the shared folder; the edges never pass through the driver, and those of a hub
    are spread over all tasks. The edge set
    is stable after O(log^2 n) rounds; more than ``rounds`` raise.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where((x != y) & x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = stored(edges, "cc-edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_per_key(both, low, "u", "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "cc-large")  # every edge points from the larger id to the smaller
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_per_key(large, low, "u", "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", "m"))
        edges = stored(small.distinct(), "cc-small")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
