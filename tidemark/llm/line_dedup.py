"""Line dedup: winnowed fingerprints of lines find runs that occurred before; the later ones are deleted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, bounded_batches, join_per_key, stored

#: A line ends at a line break or after a sentence; what ends it belongs to it, so that lines join up to the text.
LINE = "[^\\n.!?]*[.!?]*[ \\t]*\\n*"
WORD = "[^\\x20\\x09-\\x0D]+"
#: A run is deleted only if it has this many words.
LEAST_WORDS = 20
_LINE, _WORD = re.compile(LINE), re.compile(WORD)


def lines_of(text: str) -> list[str]:
    return [x for x in _LINE.findall(text) if x]


class Lines:
    """The lines of some texts laid end to end: hashes, words in each, and where each text begins."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray):
        self.hashes, self.words, self.offsets = hashes, words, offsets
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))  # of each line

    @classmethod
    def of(cls, texts: list[str]) -> Lines:
        """Each line is hashed without the blanks at its ends; words are counted within lines."""
        split = [lines_of(t) for t in texts]
        raw = [x.encode("utf-8", "replace") for lines in split for x in lines]
        hashes = np.array([xxhash.xxh3_64_intdigest(x.strip(b" \t\n\r")) for x in raw], np.uint64).view(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        begins = ~blank
        begins[1:] &= blank[:-1]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        begins[first] |= ~blank[first]  # a line's first character begins a word of the line
        upto = np.concatenate([[0], np.cumsum(begins)])
        return cls(hashes, (upto[ends] - upto[first]).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64))

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Shortest runs [start, end) within a text with ``least`` words, from each line on and up to each line."""
        n = len(self.words)
        upto = np.cumsum(self.words, dtype=np.int64)
        before = upto - self.words
        on = np.arange(n)
        ends = np.searchsorted(upto, before + least) + 1
        keep = ends <= self.offsets[1:][self.text]
        starts = np.searchsorted(before, upto - least, "right") - 1
        back = starts >= self.offsets[:-1][self.text]
        both = np.unique(np.concatenate([on[keep] * (n + 1) + ends[keep], starts[back] * (n + 1) + on[back] + 1]))
        return both // (n + 1), both % (n + 1)

    def selected(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The line that stands for each window: its leftmost minimum, by a sparse table of minima."""
        if not len(starts):
            return starts
        level = np.frexp((ends - starts).astype(np.float64))[1] - 1
        table = [np.arange(len(self.hashes))]
        for k in range(int(level.max())):
            a, b = table[-1][: -(1 << k)], table[-1][1 << k :]
            table.append(np.where(self.hashes[b] < self.hashes[a], b, a))
        out = np.empty(len(starts), np.int64)
        for k in np.unique(level):
            m = level == k
            a, b = table[k][starts[m]], table[k][ends[m] - (1 << int(k))]
            out[m] = np.where(self.hashes[b] < self.hashes[a], b, a)
        return out

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit digests of the lines of each window, from running polynomials over all lines."""
        out, n = [], len(self.hashes)
        size = (ends - starts).astype(np.uint64)
        with np.errstate(over="ignore"):
            for base in _BASES:
                inverse = np.uint64(pow(int(base), -1, 1 << 64))
                up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base))])
                down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])
                total = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes.view(np.uint64) * up[:-1])])
                out.append(((total[ends] - total[starts]) * down[starts] + size * base).view(np.int64))
        return out


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column of n rows from values sorted by their row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _parts(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 512 rows and about 4 MB of text: what is laid end to end stays small."""
    sizes = [len(t) if (t := x.as_py()) else 0 for x in batch.column(text_at)]
    at = 0
    while at < batch.num_rows:
        end, total = at, 0
        while end < batch.num_rows and end - at < 512 and (end == at or total + sizes[end] <= 4_000_000):
            total += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _fingerprints(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                n, x = part.num_rows, Lines.of(part.column(2).to_pylist())
                places = np.unique(x.selected(*x.windows(least)))
                order = np.lexsort((x.hashes[places], x.text[places]))
                mark, owner = x.hashes[places][order], x.text[places][order]
                new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])]) if len(mark) else np.empty(0, bool)
                first = np.flatnonzero(new)
                twice = np.diff(np.append(first, len(mark))) > 1
                yield pa.record_batch(
                    [part.column(0), part.column(1), _lists(x.hashes, x.text, n, pa.int64()), _lists(x.words, x.text, n, pa.int32()), _lists(mark[first], owner[first], n, pa.int64()), _lists(twice, owner[first], n, pa.bool_())],
                    ["doc_id", "version", "hashes", "words", "prints", "twice"],
                )

    return run


def _extend(least: int):
    """Windows whose fingerprint line is shared, both ways from it, with a digest of all their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, version = part.column("doc_id").to_numpy(), part.column("version").to_numpy()
                hashes, words, shared = (part.column(c) for c in ("hashes", "words", "shared"))
                x = Lines(hashes.flatten().to_numpy(), words.flatten().to_numpy(), np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy())]).astype(np.int64))
                owner = np.repeat(np.arange(part.num_rows), shared.value_lengths().to_numpy())
                starts, ends = x.windows(least)
                stands = x.selected(starts, ends)
                with np.errstate(over="ignore"):  # a text's own shared lines, told by a mix of both; a false hit only lets a window be looked at
                    known = shared.flatten().to_numpy() + owner * np.int64(0x9E3779B97F4A7C1)
                    keep = np.isin(x.hashes[stands] + x.text[stands] * np.int64(0x9E3779B97F4A7C1), known)
                starts, ends = starts[keep], ends[keep]
                text = x.text[starts]
                hi, lo = x.digests(starts, ends)
                base = x.offsets[:-1][text]
                yield pa.record_batch(
                    [pa.array(doc[text], pa.int64()), pa.array(version[text], pa.int64()), pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32)), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())],
                    ["doc_id", "version", "start", "end", "hi", "lo"],
                )

    return run


def repeated_runs(docs: DataFrame, *, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of lines that occurred earlier, by (doc_id, place): doc_id, version (hash of the text), runs [(start, end)].

    A line is in such a run exactly if some run of consecutive lines around it has ``least_words`` words or
    more and the same lines, blanks at their ends aside, stand in a row at an earlier place. Each window (the
    shortest run with that many words from a line on, or up to a line) is stood for by its minimal line hash;
    equal windows choose alike, so a repeated run always shares a fingerprint. Fingerprints found at one
    place only drop out by a count; positions of the others are joined back and extended both ways to their
    windows, and each window meets its first place by a 128-bit digest of its lines, rather than each pair of positions
    in turn: a line found in a third of all texts would pair all of them. Every step is a partial aggregation or
    a join on hashes; the windows of a common passage are spread over all tasks.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    texts = docs.where(id_.isNotNull() & text.isNotNull()).select(id_.alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    lined = stored(texts.mapInArrow(_fingerprints(least_words), "doc_id long, version long, hashes array<long>, words array<int>, prints array<long>, twice array<boolean>"), "line-hashes")
    places = lined.select("doc_id", "version", F.explode(F.arrays_zip("prints", "twice")).alias("p")).select("doc_id", "version", F.col("p.prints").alias("print"), "p.twice")
    # A text has each fingerprint once here, with a mark if it has it at several places. A repeated row of an id
    # counts as another place, which only lets more windows be looked at.
    shared = stored(places.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 OR t").select("print", "n", "t"), "line-prints")
    total = lined.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0]
    at = stored(join_per_key(places.select("doc_id", "version", "print"), shared, "print", "n", total).groupBy("doc_id", "version").agg(F.collect_set("print").alias("shared")), "line-places")
    windows = stored(lined.dropDuplicates(["doc_id", "version"]).join(at, ["doc_id", "version"]).select("doc_id", "version", "hashes", "words", "shared").mapInArrow(_extend(least_words), "doc_id long, version long, start int, end int, hi long, lo long"), "line-windows")
    first = windows.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = join_per_key(windows, first, ["lo", "hi"], "n", windows.count()).select("doc_id", "version", "start", "end", "first")
    later = met.where(F.struct("doc_id", "version", "start") > F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def _cut(with_text: bool, drop_emptied: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text_at, runs_at = names.index("__text"), names.index("__runs")
            kept, n, removed, digest = [], [], [], []
            for text, runs in zip(batch.column(text_at), batch.column(runs_at), strict=True):
                t = text.as_py()
                if runs.is_valid:
                    lines = lines_of(t)
                    n.append(len(lines))
                    step = np.zeros(len(lines) + 1, np.int64)
                    np.add.at(step, runs.values.field(0).to_numpy(), 1)
                    np.subtract.at(step, runs.values.field(1).to_numpy(), 1)
                    gone = np.cumsum(step[:-1]) > 0
                    t = "".join([lines[i] for i in np.flatnonzero(~gone)])
                    removed.append(int(gone.sum()))
                else:
                    removed.append(0)
                    n.append(len(_LINE.findall(t)) - 1 if t and not with_text else 0)  # less the empty match at the end
                kept.append(t)
                if not with_text:
                    digest.append(hashlib.sha256((t or "").encode("utf-8", "replace")).hexdigest())
            if with_text:
                columns = [batch.column(i) for i, c in enumerate(names) if c not in ("__text", "__runs")]
                out = pa.record_batch([*columns, pa.array(kept, pa.string())], [*(c for c in names if c not in ("__text", "__runs")), "__text"])
                yield out.filter(pa.array([not (r and not _WORD.search(t)) for r, t in zip(removed, kept, strict=True)], pa.bool_())) if drop_emptied else out
            else:
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_removed", "text_sha256"])

    return run


def _with_runs(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    runs = stored(repeated_runs(docs, least_words=least_words, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("runs").alias("__runs")), "line-runs")
    if (runs.agg(F.coalesce(F.sum(F.size("__runs")), F.lit(0))).first()[0]) <= BROADCAST_IDS // 2:
        runs = F.broadcast(runs)
    text = F.col(f"`{text_col}`").cast("string")
    return docs.join(runs, (F.col(f"`{id_col}`").cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__version")), "left").drop("__id", "__version")


def dedup_lines(docs: DataFrame, *, least_words: int = LEAST_WORDS, drop_emptied: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with the later of repeated runs of lines cut out of the text.

    See ``repeated_runs`` for what is cut. A text that is repeated as a whole becomes empty; its row stays, unless
    ``drop_emptied``, which drops the rows whose words were all cut (texts without words from the start stay).
    Null texts and rows without an id stay as they are and take no part. Rows that share an id are told
    apart by their text; equal ones are one place and keep the same lines. A column of counts of characters is
    not brought up to date. Very long texts are handled line by line in one task.
    """
    names = docs.columns
    found = _with_runs(docs, id_col, text_col, least_words)
    others = [c for c in names if c != text_col]
    plain = found.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.col(f"`{text_col}`").cast("string").alias("__text"), "__runs")
    fields = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    ddl = ", ".join([*(f"c{i} {fields[f'c{i}']}" for i in range(len(others))), "__text string"])
    cut = plain.mapInArrow(_cut(True, drop_emptied), ddl)
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(others)} | {text_col: F.col("__text").alias(text_col)}
    return cut.select(*(back[c] for c in names))


def line_dedup_digest(docs: DataFrame, *, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and the SHA-256 of the text that ``dedup_lines`` keeps (null: empty)."""
    found = _with_runs(docs, id_col, text_col, least_words)
    plain = found.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__text"), "__runs")
    return plain.mapInArrow(_cut(False), "doc_id long, n_lines long, n_removed long, text_sha256 string")
