"""A gated recurrent language model of words, trained in numpy inside Spark tasks; documents are scored whole."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, bucket_of, stored
from .word_blocks import BLOCK_WORDS, block_number, byte_table, numbered_words, packed, raw_texts, rows_of, slices, unpacked

#: Words with a vector of their own, classes that they are dealt to, units of the state, steps that errors flow back.
VOCABULARY, CLASSES, STATE, WINDOW = 8192, 64, 16, 16
#: Documents that are read side by side, in scoring; training takes fewer where a block has few words.
LANES = 1024
#: Every training document is learned from once; the copies of the model that tasks train are averaged after each of these parts.
ROUNDS = 3
RATE = 0.01
END = 0
#: Lower-cases A-Z and turns control characters 9 to 13 into blanks.
_TABLE = byte_table(blanks=b"\t\n\x0b\x0c\r")
#: Bytes of texts whose words are numbered at a time: their dictionary then stays in a core's cache.
_BYTES = 1 << 20
_ROWS = 1 << 16
_PIECE = 4096
#: Rows of an output that are worked on at a time: they and their gradients then stay in a core's cache.
_CHUNK = 1024


# --- texts as numbers ----------------------------------------------------------------------------------------


def _encode(block_words: int):
    """Blocks: a row (kind 1) with ids, learn flags, lengths and word numbers of its documents, and one (kind 0) per distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, of, size, parts, docs, seq = [], [], 0, [], [], 0

        def number() -> None:
            nonlocal pieces, of, size
            found, n = numbered_words(pieces, _TABLE)
            parts.append(found)
            for i, k in zip(of, n.tolist(), strict=True):
                docs[i][2] += k
            pieces, of, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, docs, seq
            numbers = pa.chunked_array(parts).unify_dictionaries()
            x, names, block = np.concatenate([c.indices.to_numpy() for c in numbers.chunks]), pc.binary_slice(numbers.chunk(0).dictionary, 0, -1), block_number(seq)
            learn = np.array([d[1] for d in docs], bool)
            n = np.bincount(x[np.repeat(learn, [d[2] for d in docs])], minlength=len(names))
            for i in range(0, len(names), _ROWS):
                some = names[i : i + _ROWS].cast(pa.binary()).cast(pa.string())
                k = len(some)
                yield pa.record_batch([pa.array([0] * k, pa.int32()), pa.array([block] * k), pa.array(np.arange(i, i + k), pa.int32()), some, pa.array(n[i : i + k], pa.int64()), *(pa.nulls(k, t) for t in _LISTS)], _NAMES)
            ids, flags, lengths = zip(*docs, strict=True)
            del names, numbers
            yield pa.record_batch([pa.array([1], pa.int32()), pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([int(learn.sum())], pa.int64()), *(pa.array([v], t) for v, t in zip((list(ids), list(flags), list(lengths), packed(x)), _LISTS, strict=True))], _NAMES)
            parts, docs, seq = [], [], seq + 1

        for batch in batches:
            for i, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                docs.append([i, learn, 0])
                for piece in slices(text, b" ", _BYTES):
                    pieces.append(piece)
                    of.append(len(docs) - 1)
                    size += len(piece) + 1
                    if size >= min(_BYTES, 4 * block_words):
                        number()
                if not pieces and sum(map(len, parts)) + len(docs) >= block_words:
                    yield from flush()
        if pieces:
            number()
        if docs:
            yield from flush()
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return run


_LISTS = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
_NAMES = ["kind", "block", "word_number", "word", "n", "ids", "learn", "lengths", "numbers"]
_BLOCK = "kind int, block long, word_number int, word string, n long, ids array<long>, learn array<boolean>, lengths array<long>, numbers binary"


@dataclass(frozen=True)
class Vocabulary:
    """Training tokens (``tokens``, ``distinct``, ``ends``) and the most frequent words with their counts, most frequent first."""

    words: list[str]
    counts: list[int]
    tokens: int
    distinct: int
    ends: int

    @property
    def rare(self) -> int:
        return len(self.words) + 1

    @property
    def rare_tokens(self) -> int:
        return self.tokens - self.ends - sum(self.counts)

    @property
    def rare_distinct(self) -> int:
        return self.distinct - len(self.words) - (self.ends > 0)


def _translate(v: Vocabulary):
    """A block in numbers of the vocabulary, with what the counts alone tell of each document."""

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        size = known.num_rows
        count, number = np.zeros(size + 1, np.int64), np.full(size + 1, v.rare, np.uint16)
        at = known.column("word_number").to_numpy()
        count[at], number[at] = known.column("c").to_numpy(), known.column("number").to_numpy()
        x, lengths = unpacked(row["numbers"], np.int32), np.array(row["lengths"], np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        y = np.full(len(x) + len(lengths), END, np.uint16)
        y[np.arange(len(x)) + doc] = number[x]
        per_doc = lambda value: np.bincount(doc, weights=value, minlength=len(lengths))
        base = per_doc(np.log10((count + 1) / (v.tokens + v.distinct + 1))[x]) + math.log10((v.ends + 1) / (v.tokens + v.distinct + 1))
        inside = np.where(number == v.rare, np.log10((count + 1) / (v.rare_tokens + v.rare_distinct + 1)), 0.0)
        seen = per_doc((count > 0)[x]).astype(np.int64) + (v.ends > 0)
        return pa.Table.from_pylist([{"ids": row["ids"], "learn": row["learn"], "lengths": (lengths + 1).tolist(), "known": seen.tolist(), "base": base.tolist(), "inside": per_doc(inside[x]).tolist(), "numbers": packed(y)}], schema=_READY_TYPES)

    return run


_READY_TYPES = pa.schema([("ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64())), ("numbers", pa.binary())])
_READY = "ids array<long>, learn array<boolean>, lengths array<long>, known array<long>, base array<double>, inside array<double>, numbers binary"


def number_texts(rows: DataFrame, *, vocabulary: int = VOCABULARY, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, Vocabulary]:
    """Blocks of documents in numbers of the most frequent training words: ``rows`` has doc_id, learn, text.

    Words are counted over all training documents; every block joins the counts of its own distinct words, so that what is
    shuffled are distinct words of blocks and the packed numbers.
    """
    bounded_batches(rows.sparkSession)
    blocks = stored(rows.select("doc_id", "learn", "text").mapInArrow(_encode(block_words), _BLOCK), "lm-blocks")
    held = blocks.where("kind = 0").select("block", "word_number", "word", "n")
    counts = stored(held.groupBy("word").agg(F.sum("n").alias("c")), "lm-words").where("c > 0")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = blocks.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.orderBy(F.desc("c"), "word").limit(vocabulary).collect()
    v = Vocabulary([r.word for r in top], [r.c for r in top], total[0] + ends, total[1] + (ends > 0), ends)
    numbers = rows.sparkSession.createDataFrame([(w, i + 1) for i, w in enumerate(v.words)], "word string, number int")
    counts = counts.join(F.broadcast(numbers), "word", "left")  # at most ``vocabulary`` rows
    known = held.select("block", "word_number", "word").join(counts, "word", "left").select("block", "word_number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("number", F.lit(v.rare)).alias("number"))
    known = known.toDF(*known.columns)
    texts = blocks.where("kind = 1").select("block", "ids", "learn", "lengths", "numbers")
    return stored(texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_translate(v), _READY), "lm-texts"), v


# --- the model -----------------------------------------------------------------------------------------------


def _softmax(z: np.ndarray, w: np.ndarray, at: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``z @ w``: the number that ``at`` names in each row, the powers of e and their sums; with ``shift`` of what is left after the largest of a row."""
    a = z @ w
    if shift:
        a -= a.max(axis=1, keepdims=True)
    picked = a.ravel()[at + np.arange(0, a.size, a.shape[1])]
    np.exp(a, out=a)
    return picked, a, a @ np.ones(a.shape[1], a.dtype)


def _softmax_errors(z: np.ndarray, w: np.ndarray, at: np.ndarray, e: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the sum of -ln P by ``w``, transposed, and by ``z``, from what ``_softmax`` returned; ``e`` is used up."""
    e *= (1 / total)[:, None]
    e.ravel()[at + np.arange(0, e.size, e.shape[1])] -= 1
    return e.T @ z, e @ w.T


class GatedModel:
    """GRU whose output is a class and then a word of the class; the edge of a text and rare words are classes of their own.

    ``into`` holds what a word adds to the reset, update and candidate gates, so its vector times the input weights; ``gates``, ``candidate`` are
    the weights of the state, ``to_class`` and ``to_word`` those of the output, with a bias in the last row or column.
    """

    def __init__(self, v: Vocabulary, *, state: int = STATE, classes: int = CLASSES, seed: int = 7) -> None:
        size, self.state = len(v.words) + 2, state
        mass = np.sqrt(np.array(v.counts, float)).cumsum()
        of = np.minimum((mass / mass[-1] * classes).astype(int), classes - 1) if len(mass) else np.empty(0, int)
        _, of = np.unique(of, return_inverse=True)
        self.class_of = np.concatenate([[0], of + 1, [(of.max(initial=-1)) + 2]]).astype(np.uint16)
        self.starts = np.searchsorted(self.class_of, np.arange(self.class_of[-1] + 2))
        rng, number = np.random.default_rng(seed), np.array([v.ends, *v.counts, v.rare_tokens], float) + 1
        self.p = {
            "into": rng.normal(0, 0.1, (size, 3 * state)).astype(np.float32),
            "gates": rng.normal(0, 0.2, (state, 2 * state)).astype(np.float32),
            "candidate": rng.normal(0, 0.2, (state, state)).astype(np.float32),
            "to_class": np.concatenate([rng.normal(0, 0.05, (state, self.starts.size - 1)), np.log(np.add.reduceat(number, self.starts[:-1]))[None] - np.log(number.sum())]).astype(np.float32),
            "to_word": np.concatenate([rng.normal(0, 0.05, (size, state)), np.log(number)[:, None] - np.log(number.sum())], axis=1).astype(np.float32),
        }

    def read(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """States before each of the steps ``x`` (steps, lanes) and after the last, from ``h``, with the gates (reset, update) and candidates; the edge of a text clears the state first.

        Each gate has an array of its own, so that numpy goes over whole arrays and not over 16 numbers at a time.
        """
        (t, b), s, p = x.shape, self.state, self.p
        own = p["into"].reshape(-1, 3, s).swapaxes(0, 1).copy()
        own[:2] *= -1  # of the gates the negative is needed
        own, weights = own.take(x, axis=1), -p["gates"].reshape(s, 2, s).swapaxes(0, 1)
        held, gates, cand = np.empty((t + 1, b, s), h.dtype), np.empty((2, t, b, s), h.dtype), np.empty((t, b, s), h.dtype)
        held[0], edges = h, self.edges(x)
        for i in range(t):
            h, g, c, to = held[i], gates[:, i], cand[i], held[i + 1]
            h[edges[i]] = 0
            np.matmul(h, weights, out=g)
            g += own[:2, i]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[0], h, out=to)
            np.matmul(to, p["candidate"], out=c)
            c += own[2, i]
            np.tanh(c, out=c)
            np.subtract(h, c, out=to)
            to *= g[1]
            to += c
        return held, gates, cand

    def edges(self, x: np.ndarray) -> list[np.ndarray]:
        """The lanes of each step where a text begins."""
        step, lane = np.nonzero(x == END)
        return np.split(lane, np.searchsorted(step, np.arange(1, len(x))))

    def states(self, held: np.ndarray, gates: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """The states after each step, from what ``read`` keeps."""
        out = held[:-1] - cand
        out *= gates[1]
        out += cand
        return out

    def predict(self, z: np.ndarray, y: np.ndarray, grow: bool, shift: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray] | None, np.ndarray | None]:
        """ln P(y) after the states ``z``; with ``grow`` also gradients of their sum, negated, by weights and states.

        Rows are laid in the order of their classes, so that those of a class lie together. Everything is done again with ``shift`` where that is needed
        for powers of e to stay finite.
        """
        n, p, k = len(y), self.p, self.class_of[y]
        order = np.argsort(k, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(k, minlength=len(self.starts) - 1))])
        own, z = z, np.ones((n, self.state + 1), z.dtype)
        z[:, :-1] = own.take(order, axis=0)
        at_class, at_word = k[order].astype(np.int64), y[order] - self.starts[k[order]]
        ln, total, total_in = np.empty(n, z.dtype), np.empty(n, z.dtype), np.ones(n, z.dtype)
        grads, dz = ({k: np.zeros_like(p[k]) for k in ("to_class", "to_word")}, np.empty_like(z)) if grow else (None, None)
        for i in range(0, n, _CHUNK):
            at = slice(i, i + _CHUNK)
            ln[at], e, total[at] = _softmax(z[at], p["to_class"], at_class[at], shift)
            if grow:
                by_class, dz[at] = _softmax_errors(z[at], p["to_class"], at_class[at], e, total[at])
                grads["to_class"] += by_class.T
        for c in np.flatnonzero((cut[1:] > cut[:-1]) & (np.diff(self.starts) > 1)).tolist():
            words = slice(self.starts[c], self.starts[c + 1])
            w = p["to_word"][words].T
            for i in range(cut[c], cut[c + 1], _CHUNK):
                at = slice(i, min(i + _CHUNK, cut[c + 1]))
                picked, e, total_in[at] = _softmax(z[at], w, at_word[at], shift)
                ln[at] += picked
                if grow:
                    by_word, errors = _softmax_errors(z[at], w, at_word[at], e, total_in[at])
                    grads["to_word"][words] += by_word
                    dz[at] += errors
        if not shift and not all(x.max(initial=1) < 1e30 and x.min(initial=1) > 1e-30 for x in (total, total_in)):
            return self.predict(own, y, grow, True)
        ln -= np.log(total)
        ln -= np.log(total_in)
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return ln[back], grads, dz.take(back, axis=0)[:, :-1] if grow else None

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of -ln P summed over the valid steps of one window, errors flowing back to its beginning; and the state to go on from."""
        (t, b), s, p = x.shape, self.state, self.p
        held, gates, cand = self.read(x, h)
        after = self.states(held, gates, cand)
        at = np.flatnonzero(valid.ravel())
        _, grads, some = self.predict(after.reshape(-1, s)[at], y.ravel()[at], True)
        from_output = np.zeros((t * b, s), after.dtype)
        from_output[at] = some
        from_output = from_output.reshape(t, b, s)
        into, dh, edges = np.empty((3, t, b, s), after.dtype), np.zeros((b, s), after.dtype), self.edges(x)
        weights, candidate, through, back = p["gates"].T.reshape(2, s, s).copy(), p["candidate"].T.copy(), np.empty_like(dh), np.empty((2, b, s), dh.dtype)
        for i in range(t - 1, -1, -1):
            (r, u), c, h = gates[:, i], cand[i], held[i]
            dh += from_output[i]
            to = np.multiply(c, c, out=into[2, i])  # becomes dh * (1 - u) * (1 - c * c)
            np.subtract(1, to, out=to)
            not_u = 1 - u
            dc = dh * not_u
            to *= dc
            dc *= u
            np.subtract(h, c, out=into[1, i])  # times dh * u * (1 - u)
            into[1, i] *= dc
            np.matmul(to, candidate, out=through)
            through *= r
            np.subtract(1, r, out=into[0, i])  # times the error before the reset gate, r and h
            into[0, i] *= through
            into[0, i] *= h
            np.matmul(into[:2, i], weights, out=back)
            dh *= u
            dh += through
            dh += back[0]
            dh += back[1]
            dh[edges[i]] = 0
        before, r = held[:-1], gates[0]
        into, before = into.reshape(3, -1, s), before.reshape(-1, s)
        grads["gates"] = np.concatenate([before.T @ into[0], before.T @ into[1]], axis=1)
        grads["candidate"] = (r.reshape(-1, s) * before).T @ into[2]
        order = np.argsort(x.ravel(), kind="stable")
        words = x.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        pairs = into.dtype if s % 2 else np.result_type(into, np.complex64)  # two numbers are added at a time
        grads["into"] = np.zeros_like(p["into"])
        grads["into"][words[first]] = np.add.reduceat(into.take(order, axis=1).view(pairs), first, axis=1).view(into.dtype).swapaxes(0, 1).reshape(-1, 3 * s)
        return grads, held[-1]


class Lanes:
    """Documents side by side: the longest are dealt first, each to the shortest lane; lanes are in order of falling length.

    Words lie lane by lane, so what is held is as long as the documents, however much longer one is than the others.
    """

    def __init__(self, y: np.ndarray, lengths: np.ndarray, count: int) -> None:
        count = max(1, min(count, len(lengths)))
        heap, lane = [(0, i) for i in range(count)], [[] for _ in range(count)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            n, i = heapq.heappop(heap)
            lane[i].append(d)
            heapq.heappush(heap, (n + int(lengths[d]), i))
        size = np.array([int(lengths[ds].sum()) for ds in lane])
        order = np.argsort(-size, kind="stable")
        self.size, docs = size[order], np.array([d for i in order for d in lane[i]], np.int32)
        self.begin, at = np.cumsum(self.size) - self.size, np.concatenate([[0], np.cumsum(lengths)])
        self.after = np.concatenate([np.empty(0, np.uint16), *(y[at[d] : at[d + 1]] for d in docs)])
        self.doc = np.repeat(docs, lengths[docs])

    def window(self, s: int, e: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, lanes) of words, of the words before them (``END`` at a beginning) and of document numbers (-1: none)."""
        at = self.begin[:lanes] + np.arange(s, e)[:, None]
        none = None if self.size[lanes - 1] >= e else np.arange(s, e)[:, None] >= self.size[:lanes]
        if none is not None:
            at[none] = 0
        after, doc = self.after[at], self.doc[at]
        if none is not None:
            after[none], doc[none] = END, -1
        before = np.empty_like(after)
        before[0], before[1:] = self.after[at[0] - 1] if s else END, after[:-1]
        if none is not None:
            before[none] = END
        return after, before, doc

    def windows(self, window: int, cells: int = 0) -> Iterator[tuple[int, int, int]]:
        """Stretches of ``window`` steps, or more where few lanes are left so that they hold about ``cells`` words, and how many lanes still have words there."""
        s = 0
        while s < self.size[0]:
            lanes = int((self.size > s).sum())
            e = min(s + max(window, cells // lanes), int(self.size[0]))
            yield s, e, lanes
            s = e


def lanes_of(y: np.ndarray, lengths: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of ``Lanes`` in one window."""
    lanes = Lanes(y, lengths, count)
    return lanes.window(0, int(lanes.size[0]), len(lanes.size))


def _stretches(lengths: np.ndarray, most: int) -> np.ndarray:
    """Lengths with those over ``most`` cut into parts, in order."""
    n = -(-lengths // most)
    out = np.full(n.sum(), most, np.int64)
    out[np.cumsum(n) - 1] = lengths - (n - 1) * most
    return out


def _adam(p: np.ndarray, m: np.ndarray, u: np.ndarray, g: np.ndarray, slow: float, n: int) -> None:
    """One step of Adam in place, from the gradients ``g`` summed over ``n`` words, which are used up."""
    g *= 0.1 / n
    m *= 0.9
    m += g
    np.square(g, out=g)
    u *= 0.99
    u += g
    np.sqrt(u, out=g)
    g += 1e-6
    np.divide(m, g, out=g)
    g *= slow
    p -= g


def _train(model: GatedModel, number: int, rounds: int, window: int, rate: float):
    """One part of the training documents of each block: Adam over windows, the state carried from one to the next. Sends the model in pieces, with the weight.

    A document longer than the lanes would be side by side is learned from in stretches that each begin with a cleared state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {k: v.copy() for k, v in model.p.items()}
        m, u, step, weight = {k: np.zeros_like(v) for k, v in mine.items()}, {k: np.zeros_like(v) for k, v in mine.items()}, 0, 0
        trained = GatedModel.__new__(GatedModel)
        trained.__dict__ |= model.__dict__ | {"p": mine}
        for batch in batches:
            for row in rows_of(batch):
                lengths = np.array(row["lengths"], np.int64)
                use = np.array(row["learn"], bool) & (np.arange(len(lengths)) % rounds == number)
                y = unpacked(row["numbers"], np.uint16)[np.repeat(use, lengths)]
                if not len(y):
                    continue
                weight += len(y)
                lanes = min(LANES, max(4, len(y) // (64 * window)))
                dealt = Lanes(y, _stretches(lengths[use], max(window, len(y) // lanes)), lanes)
                h = np.zeros((len(dealt.size), model.state), np.float32)
                for s, e, b in dealt.windows(window):
                    after, before, doc = dealt.window(s, e, b)
                    valid = doc >= 0
                    grads, h = trained.gradients(before, after, valid, h[:b])
                    step += 1
                    slow = rate * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    into, rows = grads.pop("into"), np.flatnonzero(np.bincount(before.ravel()))
                    for i in range(0, len(rows), _CHUNK // 4):
                        at = rows[i : i + _CHUNK // 4]  # only words that were read have gradients there
                        some = [held[at] for held in (mine["into"], m["into"], u["into"])]
                        _adam(*some, into[at], slow, int(valid.sum()))
                        mine["into"][at], m["into"][at], u["into"][at] = some
                    for k, g in grads.items():
                        for i in range(0, len(g), _CHUNK):
                            at = slice(i, i + _CHUNK)
                            _adam(mine[k][at], m[k][at], u[k][at], g[at], slow, int(valid.sum()))
        if weight:
            flat = np.concatenate([mine[k].ravel() for k in sorted(mine)])
            pieces = [flat[i : i + _PIECE] for i in range(0, len(flat), _PIECE)]
            yield pa.record_batch([pa.array(np.arange(len(pieces))), pa.array([weight] * len(pieces)), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "weight", "numbers"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pieces by their weights as they stream in; a task holds one array for each of its pieces."""
    total: dict[int, list] = {}
    for batch in batches:
        for piece, weight, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = total.setdefault(piece, [0, 0.0])
            held[0], held[1] = held[0] + weight, held[1] + weight * np.frombuffer(data, np.float32).astype(np.float64)
    if total:
        yield pa.record_batch([pa.array(list(total)), pa.array([w for w, _ in total.values()]), pa.array([x.tobytes() for _, x in total.values()], pa.binary())], ["piece", "weight", "numbers"])


def train_model(texts: DataFrame, v: Vocabulary, *, state: int = STATE, classes: int = CLASSES, window: int = WINDOW, rounds: int = ROUNDS, rate: float = RATE, seed: int = 7) -> GatedModel:
    """Learn from every training document of ``texts`` (of ``number_texts``) once, by averaged local descent.

    In each round every task goes over its next part of documents from the same weights, and the mean of what they come to, weighted by words, is where
    the next round starts. Tasks send their weights in pieces that other tasks add up as they stream in; the driver gets one mean.
    """
    model = GatedModel(v, state=state, classes=classes, seed=seed)
    pieces = "piece long, weight long, numbers binary"
    for i in range(rounds):
        sent = texts.select("learn", "lengths", "numbers").mapInArrow(_train(model, i, rounds, window, rate * (1 - i / (rounds + 1))), pieces)
        mean = {r.piece: np.frombuffer(r.numbers, np.float64) / r.weight for r in sent.repartition("piece").mapInArrow(_added, pieces).collect()}
        if not mean:
            continue
        flat, at = np.concatenate([mean[k] for k in sorted(mean)]), 0
        for k in sorted(model.p):
            model.p[k] = flat[at : at + model.p[k].size].reshape(model.p[k].shape).astype(np.float32)
            at += model.p[k].size
    return model


def _score(model: GatedModel, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                lengths = np.array(row["lengths"], np.int64)
                dealt = Lanes(unpacked(row["numbers"], np.uint16), lengths, LANES)
                h, total = np.zeros((len(dealt.size), model.state), np.float32), np.zeros(len(lengths))
                for s, e, b in dealt.windows(window, window * LANES):
                    after, before, doc = dealt.window(s, e, b)
                    held, gates, cand = model.read(before, h[:b])
                    h, d = held[-1], doc.ravel()
                    at = np.flatnonzero(d >= 0)
                    got, _, _ = model.predict(model.states(held, gates, cand).reshape(-1, model.state)[at], after.ravel()[at], False)
                    np.add.at(total, d[at], got) if len(at) < 64 else total.__iadd__(np.bincount(d[at], weights=got, minlength=len(total)))
                yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(lengths), pa.array(row["known"], pa.int64()), pa.array(row["base"], pa.float64()), pa.array(total / math.log(10) + np.array(row["inside"]))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(texts: DataFrame, model: GatedModel, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document; no shuffle. Windows only bound memory: the state goes on from one to the next."""
    return texts.mapInArrow(_score(model, window), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def training_share(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, learn, text): documents whose crc32 of the id modulo 7 is 2 are held out, and those without an id."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("learn", F.coalesce(bucket_of("doc_id", 7) != 2, F.lit(False)))


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probabilities of whole texts under a gated recurrent model: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts lower-cased in A-Z have the words between blanks and control characters 9 to 13, and an end. The model learns from all documents whose
    crc32 of the id modulo 7 is not 2: first the counts of all words, which give ``base_score`` (add one, log10), then a GRU over the 8,192 most frequent
    words, the end and a class of all others, with a softmax over classes and one over the words of a class, by back-propagation through 16 steps.
    A rare or unknown word has the probability of its class times (c + 1) / (N' + V' + 1), N' and V' being the rare training words, so the
    unknown ones together have the share of one, as in the base.

    Null and empty texts are an end alone. Rows without an id are scored and not learned from; their held_out is null. Repeated rows are each
    learned from and scored. Other columns are ignored. Without training documents N is 0 and every word rare. An empty table gives no rows.
    """
    texts, v = number_texts(training_share(docs, id_col=id_col, text_col=text_col))
    scores = score_texts(texts, train_model(texts, v))
    return scores.select("doc_id", (bucket_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")
