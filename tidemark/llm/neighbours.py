"""Nearest neighbours: an NN-descent graph built by joins of neighbours of neighbours, searched greedily."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_per_key, small_or_shuffled, stored

#: Neighbours kept per node, reverse ones looked at, candidates passed on per node and join.
NEIGHBOURS, REVERSE, PASSED = 40, 32, 6
#: Nodes of a random block that the graph starts from, and blocks that each node is in.
START_BLOCK, START_BLOCKS = 400, 2
BEAM = 128
#: Rounds after which a descent or a walk that has not ended fails: both end by themselves far earlier.
MOST_ROUNDS = 200


def _segments(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


def _per_group(key: str, fn: Callable[[pa.RecordBatch | pa.Table, list[tuple[int, int]]], pa.RecordBatch]):
    """Call ``fn`` with rows sorted by ``key`` and the places of whole groups; a group never spans two calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            if rest and rest[-1].column(key)[-1].as_py() == keys[0] and keys[0] == keys[-1]:
                rest.append(batch)
                continue
            last = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
            whole = pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
            if whole.num_rows:
                yield fn(whole, _segments(whole.column(key).to_numpy()))
            rest = [batch.slice(last)]
        if rest:
            whole = pa.Table.from_batches(rest).combine_chunks()
            yield fn(whole, _segments(whole.column(key).to_numpy()))

    return run


def _matrices(table: pa.Table, groups: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """The vectors of each group, which are of one length."""
    codes, scale = table.column("code").to_pylist(), table.column("scale").to_numpy()
    for s, e in groups:
        yield s, e, np.frombuffer(b"".join(codes[s:e]), np.int8).reshape(e - s, -1) * scale[s:e, None]


def _edges(src: list, dst: list, score: list) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
    return pa.record_batch([cat(src, pa.int64()), cat(dst, pa.int64()), cat(score, pa.float32())], ["src", "dst", "score"])


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, scales = [], []
        for vector in batch.column(1):
            v = vector.values.to_numpy()
            scale = max(np.abs(v).max(initial=0), 1e-300) / 127
            codes.append(np.rint(v / scale).astype(np.int8).tobytes()), scales.append(scale)
        yield pa.record_batch([batch.column(0), pa.array(codes, pa.binary()), pa.array(np.array(scales, np.float32))], ["node", "code", "scale"])


def _within_block(k: int):
    def fn(table: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        nodes = table.column("node").to_numpy()
        src, dst, score = [], [], []
        for s, e, m in _matrices(table, groups):
            if e - s < 2:
                continue
            g = m @ m.T
            np.fill_diagonal(g, -np.inf)
            n = min(k, e - s - 1)
            best = np.argpartition(-g, n - 1, axis=1)[:, :n]
            src.append(np.repeat(nodes[s:e], n)), dst.append(nodes[s:e][best].ravel()), score.append(np.take_along_axis(g, best, 1).ravel())
        return _edges(src, dst, score)

    return fn


def _local_join(table: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
    """Pairs of a node's neighbours of which one is new, each way, if nearer than the farthest neighbour so far."""
    member, fresh, kth = table.column("member").to_numpy(), table.column("fresh").to_numpy(zero_copy_only=False), table.column("kth").to_numpy()
    src, dst, score = [], [], []
    for s, e, m in _matrices(table, groups):
        f = fresh[s:e]
        if e - s < 2:
            continue
        ids = member[s:e]
        g = m @ m.T
        g[(ids[:, None] == ids) | ~(f[:, None] | f)] = -np.inf
        n = min(PASSED, e - s - 1)
        best = np.argpartition(-g, n - 1, axis=1)[:, :n]
        top = np.take_along_axis(g, best, 1)
        keep = top > kth[s:e, None]
        src.append(np.repeat(ids, n).reshape(-1, n)[keep]), dst.append(ids[best][keep]), score.append(top[keep])
    return _edges(src, dst, score)


def _nearest(k: int):
    """The k nearest distinct neighbours of each node; those that were not there before are fresh."""

    def fn(table: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        src, dst, score, old = (table.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "score", "old"))
        order = np.lexsort((~old, dst, src))  # of repeats the one that was there before comes first
        src, dst, score, old = src[order], dst[order], score[order], old[order]
        first = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
        src, dst, score, old = src[first], dst[first], score[first], old[first]
        order = np.lexsort((dst, -score, src))
        src, dst, score, old = src[order], dst[order], score[order], old[order]
        start = np.concatenate([[True], src[1:] != src[:-1]])
        place = np.arange(len(src)) - np.maximum.accumulate(np.where(start, np.arange(len(src)), 0))
        keep = place < k
        return pa.record_batch([pa.array(src[keep]), pa.array(dst[keep]), pa.array(score[keep]), pa.array(~old[keep])], ["src", "dst", "score", "fresh"])

    return fn


def _grouped(df: DataFrame, key: str, fn, ddl: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(_per_group(key, fn), ddl)


_EDGE = "src long, dst long, score float"


def _reverse(graph: DataFrame, most: int, order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("dst").orderBy(order, "src"))
    return graph.withColumn("place", place).where(F.col("place") <= most).select(F.col("dst").alias("center"), F.col("src").alias("member"), "fresh")


def neighbour_graph(codes: DataFrame, *, k: int = NEIGHBOURS, settled: float = 0.01, seed: int = 3) -> DataFrame:
    """NN-descent over (node, size, code, scale): edges (src, dst, score, fresh) to about the k nearest nodes of each.

    Nodes start with the nearest of two random blocks of nodes of their size; the nodes of a size that fit one block are all in it, however
    many there are of other sizes. In a round each node's neighbours, and up to
    ``REVERSE`` nodes that it is a neighbour of, meet at it by a join, unless none of these edges is new; pairs
    with a new edge are scored there, and each member takes the best few that are nearer than its farthest
    neighbour. It goes on until under ``settled`` of all edges are new; scores only ever rise, so it ends. A
    shuffle holds at most (k + REVERSE) 8-bit vectors per node; a node that is many nodes' neighbour is sent to
    them by a broadcast.
    """
    per_size = stored(codes.groupBy("size").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / START_BLOCK)).cast("long").alias("blocks")), "sizes")
    turns = F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, START_BLOCKS - 1).otherwise(0))).alias("turn")
    sized = codes.join(small_or_shuffled(per_size), "size").select("node", "size", "code", "scale", "blocks", turns)
    dealt = sized.select("node", "code", "scale", F.xxhash64(F.pmod(F.xxhash64("node", F.col("turn") + seed), F.col("blocks")), "turn", "size").alias("block"))
    start = _grouped(dealt, "block", _within_block(k), _EDGE).withColumn("old", F.lit(False))
    graph = stored(_grouped(start, "src", _nearest(k), f"{_EDGE}, fresh boolean"), "graph")
    for i in range(MOST_ROUNDS):
        far = graph.groupBy("src").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).select(F.col("src").alias("node"), F.when(F.col("n") < k, F.lit(float("-inf"))).otherwise(F.col("kth")).cast("float").alias("kth"))
        ties = graph.select(F.col("src").alias("center"), F.col("dst").alias("member"), "fresh").union(_reverse(graph, REVERSE, F.xxhash64("src", F.lit(i))))
        ties = ties.groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
        ties = ties.groupBy("center").agg(F.collect_list(F.struct("member", "fresh")).alias("t")).where(F.exists("t", lambda t: t["fresh"]))  # k + REVERSE at most
        ties = stored(ties.select("center", F.explode("t").alias("t")).select("center", "t.member", "t.fresh"), "ties")
        known = codes.join(far, "node", "left").join(ties.groupBy(F.col("member").alias("node")).agg(F.count(F.lit(1)).alias("uses")), "node")
        known = known.select(F.col("node").alias("member"), "code", "scale", F.coalesce("kth", F.lit(float("-inf")).cast("float")).alias("kth"), "uses")
        met = join_per_key(ties, known, "member", "uses", ties.count()).select("center", "member", "fresh", "kth", "code", "scale")
        found = _grouped(met, "center", _local_join, _EDGE).withColumn("old", F.lit(False))
        graph = stored(_grouped(graph.select("src", "dst", "score", F.lit(True).alias("old")).union(found), "src", _nearest(k), f"{_EDGE}, fresh boolean"), "graph")
        total, new = graph.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0))).first()
        if new <= settled * total:
            return graph
    raise RuntimeError(f"the graph did not settle in {MOST_ROUNDS} rounds")


def _advance(beam: int):
    """Score a query's new candidates and keep its ``beam`` nearest; what it had counts as visited."""

    def fn(table: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        role, node = table.column("role").to_numpy(), table.column("node").to_numpy()
        score, queries = table.column("score").to_numpy().copy(), table.column("query").to_numpy()
        scale = table.column("scale").to_numpy()
        codes = table.column("code")
        out = [], [], [], []
        for s, e in groups:
            r = role[s:e]
            q = s + int(np.flatnonzero(r == 0)[0])
            v = np.frombuffer(codes[q].as_py(), np.int8).astype(np.float32) * scale[q]
            had = {int(node[s + i]) for i in np.flatnonzero(r == 1)}
            new = [s + i for i in np.flatnonzero(r == 2) if int(node[s + i]) not in had]
            if new:
                m = np.frombuffer(b"".join([codes[i].as_py() for i in new]), np.int8).reshape(len(new), -1).astype(np.float32)
                score[new] = (m @ v) * scale[new]
            at = np.array([*(s + i for i in np.flatnonzero(r == 1)), *new], int)
            at = at[np.lexsort((node[at], -score[at]))][:beam]
            out[0].append(queries[at]), out[1].append(node[at]), out[2].append(score[at]), out[3].append(role[at] == 1)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
        return pa.record_batch([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float32()), cat(out[3], pa.bool_())], ["query", "node", "score", "visited"])

    return fn


def greedy_search(graph: DataFrame, codes: DataFrame, queries: DataFrame, *, beam: int = BEAM) -> DataFrame:
    """Best-first walks over the graph, all queries at once: (query, node, score) of the nearest found.

    ``queries``: nodes of the graph in column query; a walk starts from the node's own neighbours. Each
    round visits every node of a beam that was not visited, along edges either way; it ends when none is left.
    """
    own = queries.select("query")
    place = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("score"), "src"))
    back = graph.withColumn("place", place).where(F.col("place") <= REVERSE).select(F.col("dst").alias("from"), F.col("src").alias("to"))
    steps = stored(graph.select(F.col("src").alias("from"), F.col("dst").alias("to")).union(back), "steps")
    nothing = F.lit(None).cast("binary")
    start = graph.join(own, graph.src == own.query).select("query", F.col("dst").alias("node"), "score", F.lit(False).alias("visited"))
    walk = stored(start, "walk")
    for _ in range(MOST_ROUNDS):
        ahead = walk.where("not visited").select("query", F.col("node").alias("from"))
        n = ahead.count()
        if not n:
            return walk.select("query", "node", "score")
        found = stored(steps.join(ahead, "from").select("query", F.col("to").alias("node")).where("query != node").distinct(), "ahead")
        known = codes.join(found.groupBy("node").agg(F.count(F.lit(1)).alias("uses")), "node").select("node", "code", "scale", "uses")
        scored = join_per_key(found, known, "node", "uses", found.count()).select("query", F.lit(2).alias("role"), "node", F.lit(0.0).cast("float").alias("score"), "code", "scale")
        asked = own.join(codes, own.query == codes.node).select("query", F.lit(0).alias("role"), "node", F.lit(0.0).cast("float").alias("score"), "code", "scale")
        held = walk.select("query", F.lit(1).alias("role"), "node", "score", nothing.alias("code"), F.lit(0.0).cast("float").alias("scale"))
        walk = stored(_grouped(asked.union(held).union(scored), "query", _advance(beam), "query long, node long, score float, visited boolean"), "walk")
    raise RuntimeError(f"walks did not end in {MOST_ROUNDS} rounds")


def _nearest_of_all(queries: list[tuple[int, list[float]]], top: int):
    """The ``top`` nearest nodes of each query among a task's nodes of its length, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, tuple[list[int], np.ndarray]] = {}
        for n in {len(v) for _, v in queries}:
            some = [(q, v) for q, v in queries if len(v) == n]
            sides[n] = [q for q, _ in some], np.array([v for _, v in some])
        held: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(1)], int)
            for n in set(sizes.tolist()) & set(sides):
                at, (asked, m) = np.flatnonzero(sizes == n), sides[n]
                nodes = batch.column(0).to_numpy()[at]
                g = m @ batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), n).T
                k = min(top, len(at))
                best = np.argpartition(-g, k - 1, axis=1)[:, :k]
                for q, row, b in zip(asked, g, best, strict=True):
                    held[q] = sorted(held.get(q, []) + [(-float(row[i]), int(nodes[i])) for i in b])[:top]
        rows = [(q, node) for q, some in held.items() for _, node in some]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["query", "node"])

    return run


def _whole(pairs: DataFrame, nodes: DataFrame, queries: DataFrame, top: int, block: int = 500) -> DataFrame:
    """``pairs`` with what queries lack that have fewer than ``top`` candidates in them though there are more: they are held against all nodes, in blocks of queries."""
    ids = nodes.select("node", F.size("v").alias("size"), F.size("ids").alias("n"))
    there = stored(ids.groupBy("size").agg(F.sum("n").alias("there")), "sizes")  # ids beyond top + 1 of one vector do not count, and need not
    got = pairs.distinct().join(ids.select("node", "n"), "node").groupBy("query").agg(F.sum("n").alias("got"))
    need = queries.join(ids.select(F.col("node").alias("query"), "size"), "query").join(small_or_shuffled(there), "size").join(got, "query", "left")
    short = stored(need.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(top + 1), F.col("there"))).select(F.col("query").alias("node")).join(nodes.select("node", "v"), "node"), "short")
    out, some = pairs, []

    def met(asked: list) -> DataFrame:
        return nodes.select("node", "v").mapInArrow(_nearest_of_all(asked, top + 1), "query long, node long")

    for r in short.toLocalIterator():
        some.append((r.node, list(r.v)))
        if len(some) == block:
            out, some = out.union(stored(met(some), "exact")), []
    return out.union(stored(met(some), "exact")) if some else out


def nearest_vectors(vectors: DataFrame, *, top: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``top`` nearest vectors by inner product of each one whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the vectors as given, in double
    precision; nearest first, ties to the smaller id; the query's own id is left out. Graph and search work on
    vectors rounded to 8 bits; the nodes found are scored again exactly.

    Null ids, null, zero and empty vectors and those with a null or non-finite component take no part. Vectors of
    different lengths have no product: each is searched among those of its own length, be they few or many. Equal vectors are one
    node with its ``top + 1`` smallest ids, so copies in any number neither crowd the graph nor are lost.
    Repeated rows of an id and vector count once; an id with several vectors stands for each of them. Every query has ``top`` rows, or all
    candidates if they are fewer: what the walks leave short is searched for among all vectors, in blocks of queries.
    """
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    # Copies are dealt to 64 groups, each of which sends its smallest ids only.
    dealt = rows.distinct().withColumn("group", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = dealt.withColumn("place", F.row_number().over(Window.partitionBy("v", "group").orderBy("id"))).where(F.col("place") <= top + 1)
    nodes = stored(few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, top + 1).alias("ids")).select(F.xxhash64("v").alias("node"), "v", "ids"), "nodes")
    codes = stored(nodes.select("node", "v").mapInArrow(_quantise, "node long, code binary, scale float").withColumn("size", F.octet_length("code")), "codes")
    asked = stored(rows.where(F.col("id") % every == 0).select("id", F.xxhash64("v").alias("query")).distinct(), "asked")
    queries = asked.select("query").distinct()
    found = greedy_search(neighbour_graph(codes), codes, queries)
    pairs = stored(found.select("query", "node").union(queries.select("query", F.col("query").alias("node"))), "pairs")  # copies of the query itself
    pairs = _whole(pairs, nodes, queries, top).distinct()
    exact = pairs.join(nodes.select(F.col("node").alias("query"), F.col("v").alias("q")), "query").join(nodes, "node")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = exact.select("query", product.alias("score"), F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top + 1)
    mine = scored.join(asked, "query").where("id != vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
