"""Language of documents: nearest of several TF-IDF centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, bucket_of, small_or_shuffled, stored

#: Letters in a row that make a feature, and the number of hashed features.
ORDERS = (1, 2, 3)
FEATURES = 8192
#: Bound of the sample that centroids are clustered on: texts per language (about; chosen by a hash of the id).
SAMPLE_PER_LANGUAGE = 2000
CENTROIDS, ROUNDS = 4, 8
#: A text is farther than nearly all learned ones below this quantile of their best cosine.
REJECT_QUANTILE = 0.005
_MIX = np.uint32(0x9E3779B1)
#: Letters counted at a time, so that a very long text needs no more memory than that.
_CHUNK = 1 << 18


def _letter_table() -> np.ndarray:
    """Per code point: the lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


_TABLE: list[np.ndarray] = []


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed letter n-grams; runs of other characters are one word break. None without any letter."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    counts = np.zeros(FEATURES, np.float64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return None
    any_letter = False
    for at in range(0, len(points), _CHUNK):
        x = _TABLE[0][points[max(0, at - 2) : at + _CHUNK]]
        any_letter = any_letter or bool(x.any())
        brk = x == 0
        x = x[np.concatenate([[True], ~(brk[1:] & brk[:-1])])]
        h = x
        for n in ORDERS:
            if n > 1:
                if len(x) < n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX + x[n - 1 :]
            keep = x[: len(h)] != 0 if n == 1 else slice(None)
            k = (h[keep] + np.uint32(n * 7919)) * np.uint32(0x85EBCA6B)
            slot = ((k ^ (k >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 13)
            counts += np.bincount(slot, minlength=FEATURES)
    return counts if any_letter else None


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF; term frequencies are damped by a logarithm, so that a repeated line doesn't rule a text."""
    v = np.log1p(counts) * idf
    return v / max(np.linalg.norm(v), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # index into languages
    reject_below: np.ndarray  # per language


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            got = [ngram_counts(t.as_py()) for t in part.column(0)]
            keep = [i for i, g in enumerate(got) if g is not None]
            yield pa.record_batch([part.column(1).take(pa.array(keep, pa.int32())), pa.array([got[i].astype(np.float32).tobytes() for i in keep], pa.binary())], ["lang", "counts"])


def _spherical_kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    pick = [int(rng.integers(len(x)))]
    for _ in range(k - 1):  # the farthest from those picked so far
        pick.append(int((x @ x[pick].T).max(axis=1).argmin()))
    c = x[pick].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def learn_languages(docs: DataFrame, *, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> LanguageModel:
    """Learn from the rows of ``docs`` with a label: inverse document frequencies and centroids per language.

    At most about ``SAMPLE_PER_LANGUAGE`` texts of a language are used, by a hash of the id; the vectors of a
    language are clustered in one task each, which that bounds. No language is left out, however many there are:
    centroids come to the driver, at most 128 KB a language. Rows with a null id, text or label, and texts
    without letters, take no part. Without any row there are no languages, and every prediction is `und`.
    Repeated rows count as often as they occur; an id always falls on the same side of the sample.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(label).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(label).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("h"))
    totals = small_or_shuffled(stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-totals"))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_PER_LANGUAGE)) / F.col("n"))
    sample = rows.join(totals, "lang").where(F.pmod("h", F.lit(1_000_000)) <= F.lit(1_000_000) * share)
    vectors = stored(sample.select("text", "lang").mapInArrow(_vectors, "lang string, counts binary"), "lang-vectors")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES), 0
        for batch in batches:
            for v in batch.column(0):
                df += np.frombuffer(v.as_py(), np.float32) > 0
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([df.tolist()], pa.list_(pa.float64()))], ["n", "df"])

    parts = vectors.select("counts").mapInArrow(frequencies, "n long, df array<double>").select("n", F.posexplode("df").alias("i", "d")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()
    df, n = np.zeros(FEATURES), 0
    for r in parts:
        df[r.i], n = r.d, r.n
    if not n:
        return LanguageModel([], np.ones(FEATURES), np.empty((0, FEATURES)), np.empty(0, int), np.empty(0))
    idf = np.log((1 + n) / (1 + df)) + 1

    def cluster(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array([_weigh(np.frombuffer(v, np.float32).astype(np.float64), idf) for v in table.column("counts").to_pylist()])
        c = _spherical_kmeans(x, CENTROIDS, seed)
        far = float(np.quantile((x @ c.T).max(axis=1), REJECT_QUANTILE))
        return pa.table({"lang": [key[0].as_py()] * len(c), "centroid": pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary()), "far": [far] * len(c)})

    got = vectors.groupBy("lang").applyInArrow(cluster, "lang string, centroid binary, far double").collect()
    languages = sorted({r.lang for r in got})
    got = sorted(got, key=lambda r: r.lang)
    first, place = {r.lang: r.far for r in got}, {x: i for i, x in enumerate(languages)}
    return LanguageModel(languages, idf, np.array([np.frombuffer(r.centroid, np.float32) for r in got]), np.array([place[r.lang] for r in got]), np.array([first[x] for x in languages]))


def predict_language(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The nearest language of every whole text; nothing is shuffled.

    Returns one row per input row: doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1),
    rejected (true if the text is farther from the predicted language than nearly all texts that it was
    learned from; the prediction stays). Null, empty and letterless texts, and all texts of an empty model:
    `und`, 0.0, rejected. Ties go to the language that sorts first. Null ids and repeated rows are kept (the query's
    held_out is null for a null id); other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = model.idf, model.centroids.T.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [ngram_counts(t) if (t := v.as_py()) else None for v in part.column(1)]
                x = np.array([_weigh(g, idf) if g is not None else np.zeros(FEATURES) for g in got], np.float32).reshape(-1, FEATURES)
                s = x @ centroids if model.languages else np.zeros((len(got), 1))
                best = s.argmax(axis=1)
                name, score, rejected = [], [], []
                for g, b, row in zip(got, best, s, strict=True):
                    sure = g is not None and bool(model.languages)
                    name.append(model.languages[model.owner[b]] if sure else "und")
                    score.append(float(min(max(row[b], 0.0), 1.0)) if sure else 0.0)
                    rejected.append(not sure or bool(row[b] < model.reject_below[model.owner[b]]))
                yield pa.record_batch([part.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.where(bucket_of(id_col, 3) != 1)
