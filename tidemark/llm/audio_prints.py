"""Audio columns: chroma fingerprints of recordings, and their alignment by offsets and bit errors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, bounded_batches, hot_bound, stored

RATE = 1000
#: Samples of a frame and between frames; frames that one code spans.
FRAME, HOP, SPAN = 256, 64, 16
LOWEST_HZ, OCTAVES = 110.0, 2
#: Codes between the two of a landmark, votes of one offset and bit errors that an alignment takes.
STRIDE, LEAST_VOTES, MOST_ERRORS = 8, 3, 0.15
#: Landmarks that a task hands on at once.
MARKS_AT_ONCE = 100_000
#: The sieve of the landmarks that are asked for: bits for each, bits at least and at most (128 MB) as powers of two, and bits of a piece of it.
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST, SIEVE_PIECE = 16, 16, 30, 16


def _pitch_map() -> np.ndarray:
    """Frequency bins to pitch classes, from two octaves above ``LOWEST_HZ``."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    m = np.zeros((len(hz), 12), np.float32)
    for i, f in enumerate(hz):
        if f > 0 and -0.5 <= (n := 12 * np.log2(f / LOWEST_HZ)) < 12 * OCTAVES - 0.5:
            m[i, round(n) % 12] = 1
    return m


def _filters() -> list[tuple[str, int, int, int]]:
    """(kind, lowest pitch, pitches, frames) of the sixteen filters, by a rule: kinds in turn, places and sizes spread."""
    kinds = ("sum", "pitch", "time", "cross")
    return [(kinds[i % 4], (5 * i) % 8, 2 + 2 * (i // 4 % 2), 4 + 4 * (i // 4)) for i in range(16)]


_MAP, _FILTERS, _WINDOW = _pitch_map(), _filters(), np.hanning(FRAME).astype(np.float32)
_LEVELS = (-0.25, 0.0, 0.25)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame, as shares of the frame's energy."""
    if len(samples) < FRAME:
        return np.empty((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[at : at + 4096] * _WINDOW, axis=1)).astype(np.float32) ** 2
        c = power @ _MAP
        total = c.sum(axis=1, keepdims=True)
        out.append(np.where(total > 1e-9, c / np.maximum(total, 1e-9), 1 / 12))
    return np.concatenate(out)


def codes_of(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each ``SPAN`` frames: two bits of each filter over the integral image, in Gray code."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13), np.float64)
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[at + t1, y1] - total[at + t0, y1] - total[at + t1, y0] + total[at + t0, y0]

    code = np.zeros(n, np.uint32)
    for kind, y, h, w in _FILTERS:
        t, m = w // 2, y + h // 2
        if kind == "sum":
            a, b = area(0, w, y, y + h), area(0, w, 0, 12) * (h / 12)
        elif kind == "pitch":
            a, b = area(0, w, y, m), area(0, w, m, y + h)
        elif kind == "time":
            a, b = area(0, t, y, y + h), area(t, w, y, y + h)
        else:
            a, b = area(0, t, y, m) + area(t, w, m, y + h), area(0, t, m, y + h) + area(t, w, y, m)
        value = np.log((a + 0.05) / (b + 0.05))
        level = sum((value > x).astype(np.uint32) for x in _LEVELS)
        code = (code << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return code


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            n, codes, digest = [], [], []
            for pcm in part.column(1):
                raw = pcm.as_py()
                c = codes_of(chroma((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128)) if raw else np.empty(0, np.uint32)
                n.append(len(c)), codes.append(c.tobytes())
                digest.append(hashlib.sha256(c.tobytes()).hexdigest())
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(digest, pa.string())], ["rec_id", "n_codes", "codes", "fp_sha256"])


def fingerprints(recordings: DataFrame, *, id_col: str = "rec_id", audio_col: str = "pcm") -> DataFrame:
    """Chroma fingerprints of recordings: rec_id, n_codes, codes (binary, 32-bit little endian), fp_sha256.

    ``audio_col`` holds unsigned 8-bit mono samples at ``RATE``. Pitch-class energies of overlapping frames make an
    image; sixteen area filters over its integral image give two bits each. Null, empty and too short
    recordings have no codes. Each recording is one task's work; nothing is shuffled.
    """
    bounded_batches(recordings.sparkSession)
    return recordings.select(F.col(id_col).cast("long"), F.col(audio_col)).mapInArrow(_fingerprint, "rec_id long, n_codes long, codes binary, fp_sha256 string")


def _sieve_places(marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each landmark among 2**``bits``."""
    x = marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    down = np.uint64(64 - bits)
    return (x >> down).astype(np.int64), (y >> down).astype(np.int64)


def _sieve_pieces(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(np.concatenate(_sieve_places(batch.column(0).to_numpy(), bits)))
            cut = np.flatnonzero(np.diff(at >> SIEVE_PIECE, prepend=-1))
            for some in np.split(at, cut[1:]) if len(at) else []:
                held = pieces.setdefault(int(some[0]) >> SIEVE_PIECE, np.zeros(1 << SIEVE_PIECE - 3, np.uint8))
                np.bitwise_or.at(held, (some & (1 << SIEVE_PIECE) - 1) >> 3, (1 << (some & 7)).astype(np.uint8))
        for piece, held in pieces.items():
            yield pa.record_batch([pa.array([piece]), pa.array([held.tobytes()], pa.binary())], ["piece", "bits"])

    return run


def _sieve_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = np.frombuffer(data, np.uint8)
            total[piece] = total[piece] | more if piece in total else more
    for piece, held in total.items():
        yield pa.record_batch([pa.array([piece]), pa.array([held.tobytes()], pa.binary())], ["piece", "bits"])


def _sieve(asked: DataFrame, n: int) -> tuple[Broadcast, int]:
    """A broadcast Bloom filter of the ``n`` landmarks of ``asked``: tasks set bits in pieces, which other tasks unite; at most 128 MB come to the driver.

    Whatever is asked for passes; of the others about one in a hundred, and more (never all) where the bound on bits is met.
    """
    bits = min(max(SIEVE_LEAST, (SIEVE_BITS * n).bit_length()), SIEVE_MOST)
    pieces = asked.select("mark").mapInArrow(_sieve_pieces(bits), "piece long, bits binary").repartition("piece").mapInArrow(_sieve_union, "piece long, bits binary")
    held = np.zeros((1 << bits - SIEVE_PIECE, 1 << SIEVE_PIECE - 3), np.uint8)
    for r in pieces.toLocalIterator():
        held[r.piece] = np.frombuffer(r.bits, np.uint8)
    return asked.sparkSession.sparkContext.broadcast(held.tobytes()), bits


def _landmarks(sieve: tuple[Broadcast, int] | None = None):
    """Landmarks of recordings (number, codes): all, or those that pass the ``sieve``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            rec, mark, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if sieve:
                x, y = _sieve_places(mark, sieve[1])
                keep = np.flatnonzero((bits[x >> 3] >> (x & 7)) & (bits[y >> 3] >> (y & 7)) & 1)
                rec, mark, place = rec[keep], mark[keep], place[keep]
            return pa.record_batch([pa.array(rec), pa.array(mark), pa.array(place)], ["rec_id", "mark", "place"])

        bits = np.frombuffer(sieve[0].value, np.uint8) if sieve else None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for rec, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = np.frombuffer(raw.as_py(), np.uint32).astype(np.int64)
                if len(c) > STRIDE:
                    mark = (c[:-STRIDE] << 32) | c[STRIDE:]
                    at = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))  # a held tone counts once
                    held.append((np.full(len(at), rec, np.int64), mark[at], at.astype(np.int32)))
                    size += len(at)
                    if size >= MARKS_AT_ONCE:
                        size = 0
                        yield packed()
        if held:
            yield packed()

    return run


def _bit_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        overlap, errors = [], []
        for q, o, d in zip(batch.column("codes_q"), batch.column("codes_o"), batch.column("shift").to_pylist(), strict=True):
            a, b = np.frombuffer(q.as_py(), np.uint32), np.frombuffer(o.as_py(), np.uint32)
            a0, b0 = max(0, -d), max(0, d)
            n = min(len(a) - a0, len(b) - b0)
            overlap.append(n)
            wrong = np.bitwise_count(a[a0 : a0 + n] ^ b[b0 : b0 + n])
            # Recordings may share a passage only: the errors of the best quarter of the overlap, at least 16 codes, in a row.
            w = max(min(16, n), n // 4)
            runs = np.convolve(wrong, np.ones(w), "valid")
            errors.append(float(runs.min()) / (32 * w))
        names = ["query", "other", "shift", "votes"]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(overlap, pa.int64()), pa.array(errors, pa.float64())], [*names, "overlap", "bit_error"])


def align(prints: DataFrame, *, every: int = 50) -> DataFrame:
    """All alignments of each recording whose id is divisible by ``every`` with other recordings, best first.

    Equal fingerprints are one, named by the smallest rec_id. Pairs of codes a stride apart are landmarks;
    each that a query shares with others votes for an offset (those of others than queries pass a Bloom filter of the queries' ones first, so that few are shuffled); all offsets with votes enough are held to the bit
    errors of the aligned codes. Returns one row per input row, and for queries that align more than once one
    per partner and offset: rec_id, n_codes, fp_sha256, first_copy (smallest rec_id of the same fingerprint),
    match_rank (from 1), match_id, shift (codes that the match begins later), votes, bit_error. For others than
    queries, and where nothing aligns, the last five are null; recordings without codes align with nothing. Rank
    goes by more votes, fewer errors, the smaller id, the smaller shift, then an order of the fingerprints. Recordings
    are told apart by their fingerprints, so rows that share a rec_id are all aligned; repeated rows each get all
    rows of theirs; a null rec_id has no first_copy of its own and asks for nothing. The first codes of a
    repeated tone vote once.
    """
    bounded_batches(prints.sparkSession)
    first = prints.where("n_codes > 0 and rec_id is not null").groupBy("fp_sha256").agg(F.min("rec_id").alias("first_copy"), F.max((F.col("rec_id") % every == 0).cast("int")).alias("asked"))
    first = stored(first.withColumn("no", F.monotonically_increasing_id()), "audio-first")
    one = prints.join(first.withColumnRenamed("fp_sha256", "fp"), (F.col("fp_sha256") == F.col("fp")) & (F.col("rec_id") == F.col("first_copy")))
    one = stored(one.dropDuplicates(["fp_sha256"]).select("no", "first_copy", "asked", "codes"), "audio-one")
    # Landmarks that nobody asks for are left out where they arise, as far as the sieve knows them; the join on landmarks stays what decides.
    landmarks = lambda of, sieve=None: of.select("no", "codes").mapInArrow(_landmarks(sieve), "rec_id long, mark long, place int")
    asked = stored(landmarks(one.where("asked = 1")).select(F.col("rec_id").alias("query"), "mark", F.col("place").alias("q")), "audio-asked")
    marks = stored(landmarks(one, _sieve(asked, asked.count())), "audio-marks")
    # A common landmark's carriers are dealt to shares by their number, and meet its queries share by share.
    bound = hot_bound(marks.count())
    common = F.broadcast(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("mark", F.ceil(F.col("n") / bound).cast("int").alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    carriers = marks.join(common, "mark", "left").select("mark", F.pmod(F.xxhash64("rec_id"), shares).cast("int").alias("share"), F.col("rec_id").alias("other"), F.col("place").alias("o"))
    asked = asked.join(common, "mark", "left").select("query", "mark", "q", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    votes = asked.join(carriers, ["mark", "share"]).where("query != other")
    votes = votes.groupBy("query", "other", (F.col("o") - F.col("q")).alias("shift")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= LEAST_VOTES)
    votes = stored(votes, "audio-votes")
    pairs = votes.join(one.where("asked = 1").select(F.col("no").alias("query"), F.col("codes").alias("codes_q")), "query")
    partners = votes.select("other").distinct()
    partners = F.broadcast(partners) if votes.count() <= BROADCAST_IDS else partners
    pairs = pairs.join(one.join(partners, F.col("no") == F.col("other"), "left_semi").select(F.col("no").alias("other"), F.col("codes").alias("codes_o")), "other")
    held = pairs.select("query", "other", "shift", "votes", "codes_q", "codes_o").mapInArrow(_bit_errors, "query long, other long, shift int, votes long, overlap long, bit_error double").where(F.col("bit_error") <= MOST_ERRORS)
    held = held.join(one.select(F.col("no").alias("other"), F.col("first_copy").alias("match_id")), "other")
    best = held.withColumn("match_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("votes"), "bit_error", "match_id", "shift", "other")))
    best = best.select(F.col("query").alias("no"), "match_rank", "match_id", "shift", "votes", "bit_error")
    out = prints.select("rec_id", "n_codes", "fp_sha256").join(first.select("fp_sha256", "first_copy", "no"), "fp_sha256", "left")
    # Copies that are no queries have a number of their own below 0: they match nothing and crowd no task.
    mine = F.coalesce(F.col("no").isNotNull() & (F.col("rec_id") % every == 0), F.lit(False))
    out = out.withColumn("no", F.when(mine, F.col("no")).otherwise(-1 - F.monotonically_increasing_id())).join(best, "no", "left")
    return out.select("rec_id", "n_codes", "fp_sha256", "first_copy", "match_rank", "match_id", "shift", "votes", "bit_error")


def _tones() -> np.ndarray:
    """One word's samples for each of the 24 notes."""
    t = np.arange(2 * HOP) / RATE
    hz = LOWEST_HZ * 2 ** (np.arange(12 * OCTAVES) / 12)
    return (128 + 100 * np.sin(2 * np.pi * hz[:, None] * t)).astype(np.uint8)


def _sing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tones, notes = _tones(), {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            pcm = []
            for text in part.column(1):
                words = (text.as_py() or "").split()
                if len(notes) > 200_000:
                    notes.clear()
                for w in words:
                    if w not in notes:
                        notes[w] = zlib.crc32(w.encode("utf-8", "replace")) % len(tones)
                pcm.append(tones[[notes[w] for w in words]].tobytes() if words else b"")
            yield pa.record_batch([part.column(0), pa.array(pcm, pa.binary())], ["rec_id", "pcm"])


#: Ids from one conversation's first turn to the next one's: above any 32-bit turn, and 1 modulo 50, so that every turn has ids of every residue.
TURNS = 2**32 + 5


def sung_texts(turns: DataFrame) -> DataFrame:
    """Recordings derived from conversation turns: each word is a tone; rec_id = conv_id * ``TURNS`` + turn.

    The id is unique for turns from 0 below ``TURNS`` and conversations from 0 below 2**30; far beyond, the product overflows
    and fails under ANSI arithmetic.
    """
    rec = (F.col("conv_id").cast("long") * F.lit(TURNS) + F.col("turn").cast("long")).alias("rec_id")
    return turns.select(rec, F.col("text").cast("string")).mapInArrow(_sing, "rec_id long, pcm binary")
