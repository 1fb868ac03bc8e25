"""Vector code compression: codebooks per part, with distances shared along a lexicographic trie of distinct parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, join_per_key, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Leaves of the trie that are walked together.
RUN = 4096
#: Vectors of one length share codebooks; the driver holds those of so many lengths at most.
MOST_LENGTHS = 1000

Codebooks = dict[int, list[np.ndarray]]


def bounds(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end: equal where the length is divisible, else as equal as can be."""
    return [p * length // parts for p in range(parts + 1)]


def shared_prefix(parts: np.ndarray) -> np.ndarray:
    """Components that each row has in common with the row before it; none for the first."""
    same = np.cumprod(parts[1:] == parts[:-1], axis=1) if len(parts) else np.empty((0, 0))
    return np.concatenate([np.zeros(min(1, len(parts)), np.int64), same.sum(axis=1, dtype=np.int64)])


def walk(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (rows in lexicographic order) and its squared distance; ties to the lower index.

    The rows are the leaves of a trie with a component on each edge. It is walked depth first, in runs of leaves: a node's vector
    of distances to all entries is its parent's plus one component's squares, worked out once for all leaves
    below it; those on the path to the last leaf of a run are carried to the next. Rows in any other order give the same
    results and share less. Whole numbers throughout, of Python's own size where 64 bits do not hold them.
    """
    width = parts.shape[1]
    largest = max(int(np.abs(x).max(initial=0)) for x in (parts, entries))
    kind = np.int64 if 4 * largest * largest * max(width, 1) < 1 << 62 else object
    entries, prefix = entries.astype(kind), shared_prefix(parts)
    path = [np.zeros(len(entries), kind)] * (width + 1)
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), kind)
    for s in range(0, len(parts), RUN):
        rows, common = parts[s : s + RUN].astype(kind), prefix[s : s + RUN]
        below, node = np.zeros((1, len(entries)), kind), np.zeros(len(rows), np.int64)
        for d in range(width):
            opens = common <= d
            opens[0] = True
            first = np.flatnonzero(opens)
            below = below[node[first]] + (rows[first, d, None] - entries[:, d]) ** 2
            if common[0] > d:
                below[0] = path[d + 1]  # still open from the run before
            node = np.cumsum(opens) - 1
            path[d + 1] = below[-1]
        leaves = below[node]
        at = np.argmin(leaves, axis=1)
        code[s : s + len(rows)], error[s : s + len(rows)] = at, leaves[np.arange(len(rows)), at]
    return code, error


def whole_vectors(vectors: DataFrame, *, scale: int = SCALE, vec_col: str = "embedding") -> DataFrame:
    """Rows with every component x of their vector as floor(scale x) in ``v``; null vectors and those with a null or non-finite component go."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.withColumn("v", x).where(F.col("v").isNotNull() & ~bad)
    far = F.exists("v", lambda c: F.abs(c * scale) >= 2.0**62)
    whole = F.when(far, F.raise_error(F.lit(f"a component times {scale} does not fit 63 bits"))).otherwise(F.transform("v", lambda c: F.floor(c * scale).cast("long")))
    return rows.withColumn("v", whole).withColumn("length", F.size("v"))


def distinct_parts(rows: DataFrame) -> DataFrame:
    """(length, position, part, n): every distinct part with its count, stored in lexicographic order."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(p.alias("position"), F.slice("v", F.floor(p * F.col("length") / PARTS).cast("int") + 1, (F.floor((p + 1) * F.col("length") / PARTS) - F.floor(p * F.col("length") / PARTS)).cast("int")).alias("part")))
    dealt = rows.select("length", F.explode(pieces).alias("p")).groupBy("length", "p.position", "p.part").agg(F.count(F.lit(1)).alias("n"))
    return stored(dealt.repartitionByRange("length", "position", "part").sortWithinPartitions("length", "position", "part"), "distinct-parts")


def _first_entries(rows: DataFrame, id_col: str) -> Codebooks:
    """The vectors of the 16 smallest ids of each length; null ids come after all others, repeated ids by their vector."""
    lengths = [r.length for r in rows.select("length").distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out: Codebooks = {}
    for n in lengths:
        first = rows.where(F.col("length") == n).select(F.col(f"`{id_col}`").alias("i"), "v").orderBy(F.col("i").asc_nulls_last(), "v").limit(ENTRIES).collect()
        seeds, cut = np.array([r.v for r in first], np.int64).reshape(len(first), n), bounds(n)
        out[n] = [seeds[:, cut[p] : cut[p + 1]] for p in range(PARTS)]
    return out


def _runs(table: pa.Table) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of rows of one length and position."""
    length, position = (table.column(c).to_numpy() for c in ("length", "position"))
    cut = np.flatnonzero((length[1:] != length[:-1]) | (position[1:] != position[:-1])) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(length)], strict=True):
        if e > s:
            yield s, e, int(length[s]), int(position[s])


def _matrix(column: pa.ChunkedArray, s: int, e: int, width: int) -> np.ndarray:
    flat = column.slice(s, e - s).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(e - s, width)


def _sums(books: Codebooks):
    """Counts and sums of the parts that each entry is nearest to, for each task: (length, position, entry, place, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for s, e, length, p in _runs(table):
                entries = books[length][p]
                parts = _matrix(table.column("part"), s, e, entries.shape[1])
                code, _ = walk(parts, entries)
                weight = table.column("n").to_numpy()[s:e]
                fits = int(np.abs(parts).max(initial=0)) * int(weight.sum()) < 1 << 62
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                weighted = (parts if fits else parts.astype(object))[order] * weight[order, None]
                for k, n, total in zip(used.tolist(), np.add.reduceat(weight[order], first).tolist(), np.add.reduceat(weighted, first, axis=0), strict=True):
                    held = sums.setdefault((length, p, k), [0, np.zeros(entries.shape[1], object)])
                    held[0], held[1] = held[0] + n, held[1] + total.astype(object)
        rows = [(*key, i, n, str(x)) for key, (n, total) in sums.items() for i, x in enumerate(total.tolist())]
        names = ["length", "position", "entry", "place", "n", "total"]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.string() if c == "total" else pa.int64()) for i, c in enumerate(names)], names)

    return run


def learn_codebooks(rows: DataFrame, *, id_col: str = "vec_id", rounds: int = ROUNDS) -> Codebooks:
    """Lloyd rounds over the distinct parts of ``rows`` (of ``whole_vectors``): per length, an array of entries for each part.

    Parts are stored once, in lexicographic order with their counts, so that a part that a third of all vectors has is one row, and
    neighbours in a task share most of their trie. A round is one pass without a shuffle of parts: every task sends at most
    8 x 16 sums a length, summed by Spark in decimals; the driver holds codebooks only.
    """
    books, parts = _first_entries(rows, id_col), distinct_parts(rows)
    for _ in range(rounds):
        sums = parts.mapInArrow(_sums(books), "length long, position long, entry long, place long, n long, total string")
        total = sums.groupBy("length", "position", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = {n: [b.copy() for b in per_part] for n, per_part in books.items()}
        for r in total.collect():
            books[r.length][r.position][r.entry, r.place] = int(r.total) // r.n
    return books


def _encode(books: Codebooks):
    """Codes and errors of the vectors of a batch: its distinct parts are sorted and walked as one trie a position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            codes, errors = np.empty((batch.num_rows, PARTS), np.int64), np.zeros(batch.num_rows, object)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                flat = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                v, cut = flat.astype(np.int64).reshape(len(at), n), bounds(n)
                for p in range(PARTS):
                    some = v[:, cut[p] : cut[p + 1]]
                    order = np.lexsort(some.T[::-1]) if some.shape[1] else np.arange(len(at))
                    code, error = walk(some[order], books[n][p])
                    codes[at[order], p] = code
                    errors[at[order]] += error.astype(object)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(errors.tolist(), pa.int64())], [*batch.schema.names, "code", "error"])

    return run


def encode_vectors(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (of ``whole_vectors``) with ``code`` and ``error``; no shuffle."""
    bounded_batches(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_encode(books), f"{fields}, code string, error long")


def compress_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Product codes of vectors: vec_id, code, error, label_error, codebooks_sha256.

    Each component x is floor(4096 x); a vector is cut into 8 consecutive parts. A part position's 16 entries start as that part of the smallest
    ids, and 6 rounds set every entry to the floored mean of the parts nearest to it (squared Euclidean distance in whole numbers, ties to the lower
    index; an entry without parts stays). ``code`` has two hex digits a part, ``error`` the final squared distances summed, and
    ``label_error`` those summed over equal labels, nulls together; ``codebooks_sha256`` digests all entries.

    Vectors that are null or hold a null or non-finite component go. Vectors of another length have codebooks and a digest of their own, and where the
    length is not divisible by 8 parts differ by one component (so some are empty: code 00). With fewer than 16 vectors there are fewer
    entries. Null ids come last when entries start, repeated rows each count and are each returned. Components of 2^50 and
    more raise. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    slim = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("x"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = stored(whole_vectors(slim, vec_col="x").select("vec_id", "label", "v", "length"), "whole-vectors")
    books = learn_codebooks(rows)
    texts = {n: ",".join(str(x) for per_part in b for x in per_part.ravel().tolist()) for n, b in books.items()}
    digests = rows.sparkSession.createDataFrame([(n, t) for n, t in texts.items()], "length int, text string").select("length", F.sha2("text", 256).alias("codebooks_sha256"))
    coded = stored(encode_vectors(rows, books).select("vec_id", F.concat(F.lit("="), "label").alias("label"), "length", "code", "error"), "vector-codes")
    coded = coded.withColumn("label", F.coalesce("label", F.lit(""))).withColumn("key", F.xxhash64("label"))
    totals = stored(coded.groupBy("key", "label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("uses")), "label-errors")
    many = coded.count()
    out = join_per_key(coded, totals, ["key", "label"], "uses", many, bound=many // 1000)  # under 1,000 labels are broadcast
    return out.join(F.broadcast(digests), "length").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
