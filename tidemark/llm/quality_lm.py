"""Quality of documents: perplexity under a modified Kneser-Ney model of trusted text, cut by quantiles per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, small_or_shuffled, stored

#: Symbols in a row, of 64: 0 the edge of a text, 1 to 16 hex digits, 17.. the most frequent characters. Any other
#: character is spelled by the hex digits of its code point, so that no script and no rare letter is unknown.
ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS
EDGE, DIGIT, FIRST = 0, 1, 17
_SPELLED, _POINTS = 255, 0x110000
#: Characters of text whose documents are scored together.
BLOCK_CHARS = 12_000_000
_MASK = (1 << (ORDER * BITS)) - 1
_CHUNK = 1 << 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of code points: one for a frequent character, else four hex digits (six beyond the basic plane)."""
    s = table[points]
    wide = s == _SPELLED
    if not wide.any():
        return s
    n = np.where(wide, np.where(points < 0x10000, 4, 6), 1)
    out, spelled, value = np.repeat(s, n), np.repeat(wide, n), np.repeat(points, n)
    place = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(out))  # digits after this one
    out[spelled] = DIGIT + ((value[spelled] >> (4 * place[spelled]).astype(np.uint32)) & np.uint32(15))
    return out


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that end at each symbol; before the first there are edges."""
    x = np.concatenate([np.full(ORDER - 1, EDGE, np.int32), symbols.astype(np.int32)])
    g = np.zeros(len(symbols), np.int32)
    for i in range(ORDER):
        g |= x[i : i + len(symbols)] << np.int32(BITS * (ORDER - 1 - i))
    return g


def _table_of(alphabet: list[str]) -> np.ndarray:
    table = np.full(_POINTS, _SPELLED, np.uint8)
    for i, c in enumerate(alphabet):
        table[ord(c)] = FIRST + i
    return table


def frequent_characters(texts: DataFrame) -> list[str]:
    """The 47 most frequent lower-case characters of any script; ties by code point. Only those come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_POINTS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                p, k = np.unique(_points(text.as_py() or ""), return_counts=True)
                n[p] += k
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["c", "n"])

    top = texts.mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(SYMBOLS - FIRST).collect()
    return [chr(r.c) for r in top]


def gram_counts(texts: DataFrame, alphabet: list[str]) -> DataFrame:
    """(gram, n) over whole texts: counted within tasks, then summed by shards of the gram's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = _table_of(alphabet), np.zeros(_MASK + 1, np.int32)
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                if t:
                    g, k = np.unique(_grams(_symbols(_points(t), table)), return_counts=True)
                    n[g] += k.astype(np.int32)
        at = np.flatnonzero(n)
        for i in range(0, len(at), _CHUNK):
            yield pa.record_batch([pa.array(at[i : i + _CHUNK], pa.int64()), pa.array(n[at[i : i + _CHUNK]], pa.int64())], ["gram", "n"])

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("a"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from how many grams have adjusted counts 1 to 4."""
    n1, n2, n3, n4 = counts.agg(*(F.sum((F.col("a") == i).cast("long")) for i in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (x or 0 for x in (n1, n2, n3, n4))
    if not n1:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def _discount(a: Column, d: list[float]) -> Column:
    return F.when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])


def log_probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp) of the ``wanted`` grams under the interpolated model of ``counts``.

    Lower orders count the distinct symbols before a gram. Each order is one join of the wanted grams with the
    shards of its counts and one with the sums of its contexts; the lowest is mixed with the uniform one.
    """
    levels = [(counts, wanted)]
    for k in range(ORDER - 1, 0, -1):
        cut = (1 << (k * BITS)) - 1
        above, asked = levels[-1]
        levels.append((stored(above.groupBy(F.col("gram").bitwiseAND(cut).alias("gram")).agg(F.count(F.lit(1)).alias("a")), "lm-counts"), stored(asked.select(F.col("gram").bitwiseAND(cut).alias("gram")).distinct(), "lm-asked")))
    lower = None
    for k, (held, asked) in enumerate(reversed(levels), 1):
        d = _discounts(held)
        context = held.groupBy(F.shiftright("gram", BITS).alias("ctx")).agg(F.sum("a").alias("total"), F.sum(_discount(F.col("a"), d)).alias("freed"))
        rows = asked.join(held, "gram", "left").withColumn("ctx", F.shiftright("gram", BITS)).join(context, "ctx", "left")
        if lower is None:
            base = F.lit(1.0 / SYMBOLS)
        else:
            rows = rows.withColumn("low", F.col("gram").bitwiseAND((1 << ((k - 1) * BITS)) - 1)).join(lower, "low")
            base = F.col("below")
        own = F.when(F.col("a").isNotNull(), (F.col("a") - _discount(F.col("a"), d)) / F.col("total")).otherwise(0.0)
        p = F.when(F.col("total").isNull(), base).otherwise(own + F.col("freed") / F.col("total") * base)
        lower = stored(rows.select(F.col("gram").alias("low"), p.alias("below")), "lm-level")
    return lower.select(F.col("low").alias("gram"), F.log("below").cast("float").alias("logp"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows of a task in blocks of about ``BLOCK_CHARS``; the same for every reading of the same partition."""
    part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[-1] or "")
            if size >= BLOCK_CHARS:
                yield part << 20 | seq, rows
                seq, rows, size = seq + 1, [], 0
    if rows:
        yield part << 20 | seq, rows


def _block_grams(alphabet: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = _table_of(alphabet), np.zeros(_MASK + 1, bool)
        for block, rows in _blocks(batches):
            seen[:] = False
            for row in rows:
                if row[-1]:
                    seen[_grams(_symbols(_points(row[-1]), table))] = True
            at = np.flatnonzero(seen)
            for i in range(0, len(at), _CHUNK):
                yield pa.record_batch([pa.array(np.full(len(at[i : i + _CHUNK]), block)), pa.array(at[i : i + _CHUNK], pa.int64())], ["block", "gram"])

    return run


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for block, rows in _blocks(batches):
        ids, langs, texts = zip(*rows, strict=True)
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        yield pa.record_batch(
            [pa.array([block]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(langs)], pa.list_(pa.string())), pa.array([[len(x) for x in raw]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(raw))], pa.binary())],
            ["block", "ids", "langs", "sizes", "packed"],
        )


def _score_block(alphabet: list[str]):
    def score(texts: pa.Table, grams: pa.Table) -> pa.Table:
        table, logp = _table_of(alphabet), np.full(_MASK + 1, np.nan, np.float32)
        logp[grams.column("gram").to_numpy()] = grams.column("logp").to_numpy()
        out = {"doc_id": [], "lang": [], "n_chars": [], "perplexity": []}
        for row in texts.to_pylist():
            raw, at = zstandard.ZstdDecompressor().decompress(row["packed"]), 0
            for doc, lang, n in zip(row["ids"], row["langs"], row["sizes"], strict=True):
                points = _points(raw[at : at + n].decode("utf-8", "surrogatepass"))
                at += n
                total = float(logp[_grams(_symbols(points, table))].sum(dtype=np.float64)) if len(points) else 0.0
                if np.isnan(total):
                    raise RuntimeError("docs gave other rows when they were read again; store them first")
                out["doc_id"].append(doc), out["lang"].append(lang), out["n_chars"].append(len(points))
                out["perplexity"].append(float(np.exp(-total / len(points))) if len(points) else None)
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "lang": pa.array(out["lang"], pa.string()), "n_chars": pa.array(out["n_chars"], pa.int64()), "perplexity": pa.array(out["perplexity"], pa.float64())})

    return score


def held_apart(id_col: str = "doc_id") -> Column:
    """The quarter of trusted documents that thresholds are taken from, and the model is not trained on."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(4)) == 0


def quality_by_perplexity(docs: DataFrame, trusted: DataFrame, *, quantile: float = 0.99, slack: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Keep documents that read like trusted text: perplexity at most (1 + slack) times the quantile of trusted ones.

    A text that was learned from reads better than its like, so a quarter of the trusted documents is held
    apart: the quantile is that of those in the document's language.

    ``docs`` is read three times and must give the same partitions each time, as a table in files does (else the
    job fails and says so). ``trusted``: (doc_id) of trusted rows of ``docs``; all are counted but those held
    apart, or all where that leaves nothing to learn from or to hold apart.

    Characters are written in 64 symbols, those that are not frequent by their hex digits, so that a text of any
    script has letters; the model is an interpolated modified Kneser-Ney model of four symbols in a row, and
    perplexity is per character. Texts are dealt into blocks of about 12 MB; the distinct grams of each block meet the
    log probabilities by a join on the gram, and come back to their block, so that what is shuffled are
    distinct grams per block and the compressed texts, not positions.

    Returns one row per input row: doc_id, lang, n_chars, perplexity, threshold, keep. Null and empty texts:
    perplexity null, kept. A language without documents held apart, and null, is held to the quantile of all
    of them; without any trusted document threshold is null and all are kept. Repeated rows are kept;
    null ids are never trusted.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    good = stored(trusted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(rows.where("text is not null").select("doc_id"), "doc_id", "left_semi"), "lm-trusted")
    apart, rest = good.where(held_apart()), good.where(~held_apart())
    if apart.isEmpty() or rest.isEmpty():
        apart = rest = good
    texts = rows.join(small_or_shuffled(rest), "doc_id", "left_semi").select("text")
    alphabet = frequent_characters(texts)
    counts = stored(gram_counts(texts, alphabet), "lm-counts")
    held = stored(rows.mapInArrow(_block_grams(alphabet), "block long, gram long"), "lm-blocks")
    logp = log_probabilities(counts, stored(held.select("gram").distinct(), "lm-asked"))
    known = held.join(logp, "gram").select("block", "gram", "logp")
    packed = rows.mapInArrow(_block_texts, "block long, ids array<long>, langs array<string>, sizes array<long>, packed binary")
    scored = packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score_block(alphabet), "doc_id long, lang string, n_chars long, perplexity double")
    scored = stored(scored, "lm-scores")
    base = scored.where("perplexity is not null").join(small_or_shuffled(apart), "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10_000) * (1 + slack)
    by_lang = small_or_shuffled(stored(base.where("lang is not null").groupBy("lang").agg(cut.alias("own")), "lm-thresholds"))
    overall = base.agg(cut.alias("overall"))
    out = scored.join(by_lang, "lang", "left").join(F.broadcast(overall), F.lit(True), "left").withColumn("threshold", F.coalesce("own", "overall"))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", keep.alias("keep"))
