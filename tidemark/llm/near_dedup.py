"""Near-duplicate groups of documents: MinHash with banding, signature verification, star components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, connected_components, join_per_key, per_batch, small_or_shuffled, stored

BANDS, ROWS = 42, 6
#: Rows and shingles of one block of a crowded bucket, about.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
_UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD_CACHE_LIMIT = 500_000


def _coefficients(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def words_of(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; other letters stay as they are."""
    if text.isascii():  # str.split() also splits at \x1c-\x1f
        low = text.lower()
        if not any(c in low for c in "\x1c\x1d\x1e\x1f"):
            return low.split()
    low = text.translate(_UPPER_TO_LOWER)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


class ShingleHasher:
    """Sorted distinct 64-bit hashes of a text's word n-grams (all words as one, if there are fewer than n)."""

    def __init__(self, n: int):
        self.n, self.ids = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text) if text else []
        if not words:
            return np.empty(0, np.uint64)
        ids = self.ids
        if len(ids) > _WORD_CACHE_LIMIT:
            ids.clear()
        try:
            h = np.array([ids[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in ids:
                    ids[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.array([ids[w] for w in words], np.uint64)
        n = min(self.n, len(words))
        out = h[: len(h) - n + 1].copy()
        with np.errstate(over="ignore"):
            for i in range(1, n):  # order matters: a polynomial over the word hashes, mixed at each step
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
            out ^= out >> np.uint64(31)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(27)
            out += np.uint64(n)
        return np.unique(out)


def _node(shingles: np.ndarray) -> int:
    """The 64-bit name of a shingle set: equal sets are one node from here on."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash (a*x + b mod 2^32) over the shingles, in blocks that stay in cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        v = np.multiply.outer(x[i : i + 256], a)
        v += b
        np.minimum(low, v.min(axis=0), out=low)
    return low


def _sketcher(n: int, bands: int, rows: int, seed: int):
    a, b = _coefficients(bands * rows, seed)
    mix = np.random.default_rng(seed + 1).integers(1, 1 << 62, (bands, rows), dtype=np.uint64) | np.uint64(1)
    tag = np.random.default_rng(seed + 2).integers(1, 1 << 62, bands, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, keys, sigs, band_keys = [], [], [], []
                for text in part.column(1):
                    s = hasher(text.as_py())
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None), sigs.append(None), band_keys.append(None)
                        continue
                    low = _minima(s, a, b)
                    with np.errstate(over="ignore"):
                        k = (((low & np.uint32(255)).reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * mix).sum(axis=1, dtype=np.uint64) + tag
                        k ^= k >> np.uint64(33)
                        k *= np.uint64(0xFF51AFD7ED558CCD)
                        k ^= k >> np.uint64(33)
                    keys.append(_node(s))
                    sigs.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                    band_keys.append(k.view(np.int64))
                yield pa.record_batch(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary()), pa.array(band_keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "rep", "sig", "bands"],
                )

    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [s for t in part.column(1) if len(s := hasher(t.as_py()))]
                yield pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    return run


def _sig_matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, k)


def _verify_signatures(k: int, least: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = (_sig_matrix(batch.column("sig_a"), k) == _sig_matrix(batch.column("sig_b"), k)).sum(axis=1) >= least
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return per_batch(one)


def _verify_sets(percent: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, x = [], None, None
        for a, s, t in zip(batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b"), strict=True):
            if a != last:
                last, x = a, np.frombuffer(s.as_py(), np.uint64)
            y = np.frombuffer(t.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return per_batch(one)


class _Block:
    """Members of a bucket's block (or of two blocks), and the links between their components."""

    def __init__(self, group: pa.Table, bands: int, rows: int, least: int, percent: int):
        self.rep, self.side = group.column("rep").to_numpy(), group.column("side").to_numpy()
        self.band = group.column("band").to_numpy()[0]
        self.sig = _sig_matrix(group.column("sig").combine_chunks(), bands * rows)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        self.size = np.array([len(x) for x in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        values, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(values), bool)
        self.bands, self.rows, self.least, self.percent = bands, rows, least, percent
        roots: dict[int, int] = {}
        self.parent = np.array([roots.setdefault(c, i) for i, c in enumerate(group.column("component").to_pylist())])

    def _codes(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i + 1]]

    def _shared(self, i: int, js: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with the sets js, by a marked vocabulary."""
        self.flag[self._codes(i)] = True
        out = np.array([np.count_nonzero(self.flag[self._codes(j)]) for j in js])
        self.flag[self._codes(i)] = False
        return out

    def links(self) -> tuple[list[int], list[int]]:
        first, second = np.flatnonzero(self.side != 1), np.flatnonzero(self.side != 0)
        a, b, parent = [], [], self.parent
        for i in first:
            js = second[(parent[second] != parent[i]) & ((self.side[second] != 2) | (second > i))]
            if not len(js):
                continue
            same = self.sig[js] == self.sig[i]
            keep = same.sum(axis=1) >= self.least
            js, same = js[keep], same[keep]
            if len(js):  # a pair is looked at in the first bucket that it shares, and in no other
                js = js[same.reshape(len(js), self.bands, self.rows).all(axis=2).argmax(axis=1) == self.band]
            if not len(js):
                continue
            both = self._shared(i, js)
            for j in js[100 * both >= self.percent * (self.size[i] + self.size[js] - both)]:
                if parent[j] != parent[i]:
                    a.append(int(self.rep[i])), b.append(int(self.rep[j]))
                    parent[parent == parent[j]] = parent[i]  # the sets are whole, so the link is confirmed
        return a, b


def _cross_links(bands: int, rows: int, least: int, percent: int):
    """Links that join different components, found block by block: a spanning set, not all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = _Block(pa.Table.from_batches(held), bands, rows, least, percent).links()
                held.clear()
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        last = None
        for batch in batches:  # sorted by group; only one group's rows (two blocks at most) are held
            if not batch.num_rows:
                continue
            g = list(zip(batch.column("bucket").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True))
            start = 0
            for i in range(len(g)):
                if g[i] != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield from flush()
                    start, last = i, g[i]
            held.append(batch.slice(start))
        yield from flush()

    return run


def near_duplicate_groups(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose word-shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable over links, its
    own included), kept (doc_id = component_id).

    Every document is reduced to ``bands * rows`` universal hash minima. Equal sets collapse first, so a group
    of exact copies is one representative from then on. Representatives that share a band bucket are
    candidates. A first round holds each against the smallest member of its buckets. A second one holds the
    members of a bucket against each other, block by block, where their components differ: by signature, then
    by their sets; each block passes on the links that join components, not all pairs. Members of the component
    that most of a bucket is in are dealt to blocks of their own, which meet those of the others only. All links
    are confirmed on full 64-bit sets. With 42 bands of 6 rows a pair at exactly 0.8
    shares no bucket with probability 3e-6; no bucket is capped.

    A representative stands for all rows of one set, and is named by a 64-bit digest of it. Representatives of a
    bucket in as many components as there are members are compared in pairs of blocks: this work grows with the
    square of such a bucket, over as many tasks as there are pairs of blocks.

    Null or empty text and text without words: n_shingles 0, linked with nothing, kept. Rows without an id are
    linked with nothing: component_id null, kept. Rows that share an id are placed by
    their own text; repeated rows are all kept or all dropped. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    k = bands * rows
    least = int(k * (percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / k) ** 0.5))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = stored(texts.mapInArrow(_sketcher(words, bands, rows, seed), "doc_id long, n_shingles long, rep long, sig binary, bands array<long>"), "sketch")

    keyed = sketch.where("doc_id is not null and rep is not null")
    firsts = stored(keyed.groupBy("rep").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("set_size"), F.count(F.lit(1)).alias("copies")), "firsts")
    reps = firsts.select("rep", "sig", "bands")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    crowded = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = stored(banded.join(crowded, "bucket"), "buckets")
    members = stored(buckets.select("rep").distinct().join(firsts.select("rep", "first_id"), "rep"), "members")
    wanted = texts.join(small_or_shuffled(members.select(F.col("first_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(_set_rows(words), "rep long, shingles binary").dropDuplicates(["rep"]), "sets")
    sigs = firsts.select("rep", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_verify_signatures(k, least), "a long, b long")
        full = likely.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
        return full.select("a", "b", "set_a", "set_b").mapInArrow(_verify_sets(percent), "a long, b long")

    star = buckets.where("rep != pivot").groupBy("rep").agg(F.min("pivot").alias("a")).select("a", F.col("rep").alias("b"))
    links = stored(confirmed(star), "links")
    groups = stored(connected_components(links, "a", "b"), "groups")

    def with_component(df: DataFrame) -> DataFrame:
        return df.join(groups, df.rep == groups.node, "left").withColumn("component", F.coalesce("component", "rep")).drop("node")

    placed = with_component(buckets.select("bucket", "band", "rep").join(firsts.select("rep", "set_size"), "rep"))
    per = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("set_size").alias("shingles"))
    main = F.max_by(F.struct("component", "n", "shingles"), F.struct("n", "component"))
    mixed = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), main.alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_SHINGLES))).cast("int")
    mixed = mixed.select("bucket", (blocks(F.col("n"), F.col("shingles")) == 1).alias("lone"), F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.shingles")).alias("big"), blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("rest"))
    # A bucket that fits into one block is that block. Else blocks 0 to big - 1 hold the main component, blocks from
    # there on the others; two blocks of the main one never meet.
    in_main, lone = F.col("component") == F.col("main"), F.col("lone")
    own = F.when(lone, F.lit(0)).when(in_main, F.pmod(F.xxhash64("rep"), F.col("big"))).otherwise(F.col("big") + F.pmod(F.xxhash64("rep"), F.col("rest"))).cast("int")
    rowsets = placed.join(mixed, "bucket").join(sigs.join(sets, "rep"), "rep").withColumn("own", own)
    meets = F.when(lone, F.array(F.lit(0))).when(in_main, F.sequence(F.col("big"), F.col("big") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("big") + F.col("rest") - 1))
    dealt = rowsets.withColumn("other", F.explode(meets)).select(
        "bucket",
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "band",
        "rep",
        "component",
        "sig",
        "shingles",
    )
    dealt = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    cross = stored(dealt.mapInArrow(_cross_links(bands, rows, least, percent), "a long, b long").distinct(), "cross")
    links = stored(links.union(cross), "links")
    groups = connected_components(links, "a", "b")

    named = stored(firsts.select("rep", "first_id", "copies").join(groups, firsts.rep == groups.node, "left").select("rep", "first_id", "copies", F.coalesce("component", "rep").alias("component")), "named")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labels = join_per_key(named, lowest, "component", "n", named.count()).select("rep", "copies", "component_id")
    ids = sketch.select("doc_id", "n_shingles", "rep")
    grouped = join_per_key(ids.where("doc_id IS NOT NULL AND rep IS NOT NULL"), labels, "rep", "copies", sketch.count()).drop("rep")
    alone = ids.where("doc_id IS NULL OR rep IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a group of near-duplicates can spare.

    The row with the smallest doc_id of each group stays; see ``near_duplicate_groups``.
    """
    dropped = stored(near_duplicate_groups(docs, **options).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    gone = small_or_shuffled(dropped)
    return docs.join(gone, F.col("doc_id") == F.col("__dropped"), "left_anti")
