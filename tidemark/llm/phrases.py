"""Collocations: phrases counted length by length over all texts, where the shorter ones that they are made of are frequent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, small_or_shuffled, stored
from .word_blocks import BLOCK_WORDS, BORDER, Numbering, block_number, byte_table, packed, raw_texts, rows_of, slices, unpacked

LONGEST = 5
#: Phrases of one length that a task holds with their counts before it sends them (16 bytes each).
SHARD_WORDS = 1_500_000
#: Words of a row of numbers: a few arrays of that length are held at a time.
ROW_WORDS = 500_000
#: Frequent words that every task may hold (some 30 MB); where there are more, each block meets its own by a join.
MOST_WORDS = 300_000
#: Frequent phrases are sent to the tasks that count longer ones, as codes (96 MB), up to so many; beyond, all phrases of frequent words are counted by their words.
MOST_CANDIDATES = 12_000_000
#: Parts that a language's phrases are dealt to before its first ones are taken.
DEALT = 64
_TABLE = byte_table(b".,;:!?\n\x0b\x0c\r")
_ROWS = 1 << 16


def _encode(block_words: int):
    """Blocks of a language: one row (kind 1) with the numbers of its words, 0 a border, and one (kind 0) per distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, tuple[Numbering, list[np.ndarray]]] = {}
        seq = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, size
            while open_blocks:
                lang, (words, parts) = open_blocks.popitem()
                x, names = np.concatenate(parts), list(words.of)
                n = np.bincount(x, minlength=len(names))
                del words, parts
                block, total = block_number(seq), len(x) - int(n[0])
                seq += 1
                for i in range(1, len(names), _ROWS):
                    some = names[i : i + _ROWS]
                    k = len(some)
                    yield _row_batch([0] * k, [block] * k, [lang] * k, [total] * k, np.arange(i, i + k), some, n[i : i + k], [None] * k, [None] * k)
                yield _row_batch([1], [block], [lang], [total], [None], [None], [None], [packed(x)], [names[1:]])
            size = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                for part in slices(text.translate(_TABLE), BORDER):
                    found = part.replace(BORDER, b" \xff ").split()
                    if found:
                        if lang not in open_blocks:
                            open_blocks[lang] = Numbering(BORDER), []
                        words, parts = open_blocks[lang]
                        found.append(BORDER)
                        parts.append(words.numbers(found))
                        size += len(found)
                        if size >= block_words:
                            yield from flush()
        yield from flush()

    return run


_BLOCK = "kind int, block long, lang string, total long, word_number int, word string, n long, numbers binary, dictionary array<binary>"


def _row_batch(kind, block, lang, total, number, word, n, numbers, dictionary) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    columns = [pa.array(x, t) for x, t in zip((kind, block, lang, total, number, word, n, numbers, dictionary), kinds, strict=True)]
    columns[5] = columns[5].cast(pa.string())
    return pa.record_batch(columns, ["kind", "block", "lang", "total", "word_number", "word", "n", "numbers", "dictionary"])


#: Counts of phrases leave a task in so many pieces by their code.
_PIECES = 512
_SHARD = "numbers binary"
_COUNTED = "piece int, codes binary, counts binary"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers packed byte by byte of all: those of small numbers are zeros that take no room."""
    return packed(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T))


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _dense(x: np.ndarray) -> np.ndarray:
    """Word numbers with one 0 between stretches; words without a neighbour, which are in no phrase, go."""
    there = np.concatenate([[False], x > 0, [False]])
    kept = there[1:-1] & (there[:-2] | there[2:])
    return x[kept | (np.concatenate([[False], kept])[:-1] & ~kept)]


def _rows_of_numbers(x: np.ndarray) -> list[bytes]:
    """Word numbers in rows of about ``ROW_WORDS``, each cut between stretches."""
    x, out, at = _dense(x), [], 0
    cuts = np.flatnonzero(x == 0)
    while len(x) - at > ROW_WORDS and (i := np.searchsorted(cuts, at + ROW_WORDS)) < len(cuts):
        out.append(packed(x[at : cuts[i]]))
        at = int(cuts[i]) + 1
    return [*out, packed(x[at:])]


def _renumbered(frequent: Broadcast):
    """Blocks in numbers of frequent words, which are at hand; 0 stands for all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                of_lang = frequent.value[0].get(row["lang"], {})
                number = np.array([0, *(of_lang.get(w, 0) for w in row["dictionary"])], np.int32)
                yield pa.record_batch([pa.array(_rows_of_numbers(number[unpacked(row["numbers"], np.int32)]), pa.binary())], ["numbers"])

    return run


def _renumbered_joined(blocks: pa.Table, frequent: pa.Table) -> pa.Table:
    """A block in numbers of those of its words that are frequent, brought to it by a join."""
    x = unpacked(blocks.column("numbers")[0].as_py(), np.int32) if blocks.num_rows else np.zeros(0, np.int32)
    number = np.zeros(int(x.max(initial=0)) + 1, np.int32)
    if len(x):
        number[frequent.column("word_number").to_numpy()] = frequent.column("number").to_numpy()
    return pa.table({"numbers": pa.array(_rows_of_numbers(number[x]), pa.binary())})


def _places(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each code among sorted ``keys``, from 1; 0 where it is none of them."""
    if not len(keys):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return (at + 1) * (keys[at] == codes)


def _next(x: np.ndarray, g: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the phrases of ``k`` words whose first and last k - 1 words are frequent phrases, whose numbers are ``g``.

    A code is the number of the phrase without its last word times ``base``, and that word's number.
    """
    at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0))
    return at, g[at] * np.int64(base) + x[at + (k - 1)]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by code, sorted."""
    codes, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(codes) else n


def _count_level(known: Broadcast, base: int, most: int):
    """Occurrences of phrases one word longer than those ``known``, summed over a task's blocks, in pieces: sorted codes as differences, and counts."""

    def told(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        piece = ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int32)
        order = np.argsort(piece, kind="stable")
        cut = np.searchsorted(piece[order], np.arange(_PIECES + 1))
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            own = order[cut[i] : cut[i + 1]]
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([_planes(np.diff(codes[own], prepend=0))], pa.binary()), pa.array([_planes(n[own])], pa.binary())], ["piece", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for row in rows_of(batch):
                x = unpacked(row["numbers"], np.int32)
                g = x.astype(np.int64)
                for k, keys in enumerate(known.value, 2):
                    at, codes = _next(x, g, k, base)
                    g = np.zeros(max(0, len(g) - 1), np.int64)
                    g[at] = _places(codes, keys)
                held.append(np.unique(_next(x, g, len(known.value) + 2, base)[1], return_counts=True))
                size += len(held[-1][0])
                if size > most:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from told(*held[0])
                        held, size = [], 0
        if held:
            yield from told(*_merged(held))

    return run


def _sum_pieces(support: int):
    """Sums of one piece after the other: (code, n) of phrases that reach the support."""

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codes, n = _merged(held)
        return pa.record_batch([pa.array(codes[n >= support]), pa.array(n[n >= support])], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in rows_of(batch):
                if row["piece"] != now and held:
                    yield told(held)
                    held = []
                now = row["piece"]
                held.append((np.cumsum(_from_planes(row["codes"], np.int64)), _from_planes(row["counts"], np.int64)))
                if len(held) >= 64:
                    held = [_merged(held)]
        if held:
            yield told(held)

    return run


def _words_of(known: Broadcast, base: int):
    """Codes of phrases one word longer than those ``known`` to the numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, words = batch.column(0).to_numpy(), []
            for keys in reversed(known.value):
                words.append(code % base)
                code = keys[code // base - 1]
            words = np.stack([code // base, code % base, *reversed(words)], axis=1).astype(np.int32)
            yield pa.record_batch([pa.array([w.tobytes() for w in words], pa.binary()), batch.column(1)], ["words", "n"])

    return run


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of all phrases of frequent words in each block, by the numbers of their words."""
    for batch in batches:
        for row in rows_of(batch):
            x = unpacked(row["numbers"], np.int32)
            for k in range(2, LONGEST + 1):
                windows = np.lib.stride_tricks.sliding_window_view(x, k) if len(x) >= k else np.zeros((0, k), np.int32)
                words, n = np.unique(windows[(windows > 0).all(axis=1)], axis=0, return_counts=True)
                for i in range(0, len(words), _ROWS):
                    yield pa.record_batch([pa.array([w.tobytes() for w in words[i : i + _ROWS]], pa.binary()), pa.array(n[i : i + _ROWS])], ["words", "n"])


def _spelled(frequent: Broadcast):
    """Phrases by the numbers of their words to language and text; the frequent words are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, langs, names = frequent.value
        for batch in batches:
            rows = [np.frombuffer(w, np.int32).tolist() for w in batch.column(0).to_pylist()]
            texts = pa.array([b" ".join([names[i] for i in r]) for r in rows], pa.binary()).cast(pa.string())
            yield pa.record_batch([pa.array([langs[r[0]] for r in rows], pa.string()), texts, batch.column(1)], ["lang", "phrase", "n"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a phrase."""
    for batch in batches:
        rows = [(w, n, i, x) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, x in enumerate(np.frombuffer(w, np.int32).tolist())]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int32()))], ["words", "n", "place", "number"])


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their task and their place in it, from 1."""
    n = 1
    for batch in batches:
        k = batch.num_rows
        yield pa.record_batch([*batch.columns, pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array(np.arange(n, n + k, dtype=np.int32))], [*batch.schema.names, "task", "at"])
        n += k


def phrase_counts(docs: DataFrame, *, support: int = 100, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Words and phrases of 2 to 5 words with at least ``support`` occurrences in a language, each counted over all texts.

    Returns (words: lang, word, n, lang_words; phrases: lang, phrase, n). Texts are split as ``collocations`` says.

    Documents are cut into blocks of about ``block_words`` words, long texts at the borders of pieces. A phrase reaches the support only if its words do,
    and the two phrases one word shorter that it is made of. So words are counted first, then phrases of 2 words, of 3 and so on, each length over all
    blocks exactly, at the places where both shorter ones are frequent. A phrase's code is the number of the frequent phrase without its last word, and
    that word's number; a task sums the counts of its blocks, up to ``shard_words`` codes at a time, before it sends them. Shuffled are distinct words of
    blocks and distinct codes of tasks with their counts, packed, never positions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_encode(block_words), _BLOCK), "phrase-blocks")
    held = blocks.where("kind = 0").select("block", "lang", "word_number", "word", "n")
    words = stored(held.groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
    langs = stored(words.groupBy("lang").agg(F.sum("n").alias("lang_words")), "phrase-langs")
    frequent = words.where(F.col("n") >= support).join(small_or_shuffled(langs), "lang").select("lang", "word", "n", "lang_words")
    frequent = stored(frequent.mapInArrow(_counted_rows, "lang string, word string, n long, lang_words long, task int, at int"), "phrase-frequent")
    sizes = {r["task"]: r["count"] for r in frequent.groupBy("task").count().collect()}  # a row a task
    before = [sum(n for t, n in sizes.items() if t < task) for task in range(max(sizes, default=0) + 1)]
    numbered, n_words = frequent.withColumn("number", F.get(F.array(*map(F.lit, before)), F.col("task")) + F.col("at")).select("lang", "word", F.col("number").cast("int").alias("number")), sum(sizes.values())
    found, base = frequent.drop("task", "at"), n_words + 1
    shards = blocks.where("kind = 1").select("block", "lang", "numbers", "dictionary")
    alone = n_words <= MOST_WORDS
    if alone:
        of: dict[str, dict[bytes, int]] = {}
        lang_of, names = [""] * base, [b""] * base
        for r in numbered.toLocalIterator():
            lang_of[r.number], names[r.number] = r.lang, r.word.encode("utf-8", "surrogatepass")
            of.setdefault(r.lang, {})[names[r.number]] = r.number
        sent = spark.sparkContext.broadcast((of, lang_of, names))
        shards = stored(shards.select("lang", "numbers", "dictionary").mapInArrow(_renumbered(sent), _SHARD), "phrase-shards")
    else:
        own = held.join(numbered, ["lang", "word"]).select("block", "word_number", "number").toDF("block", "word_number", "number")
        shards = stored(shards.select("block", "numbers").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_renumbered_joined, _SHARD), "phrase-shards")
    phrases, known, n_known = None, [], 0
    for k in range(2, LONGEST + 1):
        codes = spark.sparkContext.broadcast(list(known))
        counted = shards.mapInArrow(_count_level(codes, base, shard_words), _COUNTED).repartition("piece").sortWithinPartitions("piece")
        level = stored(counted.mapInArrow(_sum_pieces(support), "code long, n long"), f"phrase-level{k}")
        n_level = level.count()
        if not n_level:
            break
        spelled = level.mapInArrow(_words_of(codes, base), "words binary, n long")
        phrases = spelled if phrases is None else phrases.union(spelled)
        n_known += n_level
        if k < LONGEST and n_known > MOST_CANDIDATES:
            phrases = shards.mapInArrow(_count_all, "words binary, n long").groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
            break
        if k < LONGEST:
            known.append(np.sort(level.select("code").toArrow().column(0).to_numpy()))
    if phrases is None:
        return found, spark.createDataFrame([], "lang string, phrase string, n long")
    if alone:
        return found, stored(phrases.mapInArrow(_spelled(sent), "lang string, phrase string, n long"), "phrase-counts")
    spelled = phrases.mapInArrow(_placed, "words binary, n long, place int, number int").join(numbered, "number")
    spelled = spelled.groupBy("words", "n").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return found, stored(spelled.select("lang", "phrase", "n"), "phrase-counts")


def _floor_ratio(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in exact integers: floor(A / B) by whole parts of decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    top, bottom = (wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")
    return ((top - F.pmod(top, bottom)).cast("decimal(38,0)") / bottom).cast("long")


def collocations(docs: DataFrame, *, support: int = 100, top: int = 2000, covered_percent: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` collocations: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts lower-cased in A-Z are split at ``[.,;:!?`` and line breaks ``]`` into pieces and those at blanks and tabs into words.
    A phrase of 2 to 5 words counts all its occurrences inside pieces, overlaps included. Candidates occur at least
    ``support`` times (a). A cut after the first k words gives l and r, the occurrences of both parts, and floor(1000 a n / (l r)), n being
    the words of the language; the lowest counts, ties to the smallest k. A candidate inside a longer one with
    ``covered_percent`` % of its occurrences or more goes. Order: score and a descending, then the phrase by its bytes.

    Null and empty texts have no words. A null language is ``und``, together with texts that are marked so. Repeated rows count
    each time. Further columns are ignored; an empty table, and a language without candidates, gives no rows.
    """
    words, phrases = phrase_counts(docs, support=support, text_col=text_col, lang_col=lang_col)
    parts = stored(words.select("lang", F.col("word").alias("part"), "n").union(phrases.select("lang", "phrase", "n")), "phrase-parts")
    split = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("ws")).withColumn("size", F.size("ws"))
    span = lambda ws, start, size: F.array_join(F.slice(ws, start, size), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", span("ws", F.lit(1), F.col("k")).alias("head"), span("ws", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    langs = small_or_shuffled(stored(words.select("lang", F.col("lang_words").alias("n")).distinct(), "phrase-langs"))
    cuts = cuts.join(langs, "lang").withColumn("score", _floor_ratio(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    inner = F.explode(F.expr("flatten(transform(sequence(2, size - 1), j -> transform(sequence(1, size - j + 1), i -> array_join(slice(ws, i, j), ' '))))"))
    covered = split.where("size > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.select("lang", "phrase", "b.*").join(covered, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = kept.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
