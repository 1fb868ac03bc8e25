"""Toxicity of documents: a lexicon learned from labels, matched with misspellings, scored in context."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, bucket_of, stored

#: Bound of what is learned from: distinct labelled texts at most (about; chosen by a hash of the id).
MAX_TRAINING_DOCS = 20_000
#: Groups of alike texts of label 1 that a term must be found in, and the share of clean texts among those that have it, at most.
LEAST_GROUPS, MOST_CLEAN = 4, 0.05
#: Candidate terms, a word and its beginnings being several, that a text must have to be held against others as a copy.
FEW_TERMS = 30
#: Minima of a text's words, in bands of so many, and the share of them that near copies have in common.
MINIMA, BAND, ALIKE = 96, 3, 0.6
#: Words around a hit that make its context: for address on either side, for reports and for denials before it.
WINDOW, REPORT_WINDOW, DENIAL_WINDOW = 10, 3, 2
#: What a hit counts by its edits, and what is taken off one that is reported or denied.
BY_EDITS, TAKEN_OFF = (1.0, 0.9, 0.8), 0.5
#: Lengths of word beginnings that are tried as stems.
STEMS = (4, 5, 6, 7, 8)
# Words of the corpus' languages that report speech, deny, or address the reader.
REPORTS = frozenset("said says called calls wrote word term phrase quote quoted nannte sagte sagt schrieb wort begriff dit appelé appelle écrit mot terme dijo dice llamó escribió palabra término".split())
DENIALS = frozenset("not never isn nicht kein keine keinen pas jamais nunca".split())
ADDRESS = frozenset("you your yours du dich dir dein deine ihr euch tu te toi ton vous votre usted ustedes tú vosotros".split())
_WORD = re.compile(r"\w+")
_QUOTES = re.compile("[\"“”„«»‹›'‘’]")
#: Characters between paired marks at most, of all kinds and of single marks (which apostrophes look like).
QUOTED_CHARS, SINGLE_CHARS = 500, 80
_SEEN_LIMIT = 400_000


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Term:
    """A lexicon entry: a whole word, or a stem with any ending; its weight is the log odds of label 1.

    ``edits``: how far misspellings may be off; by length if not given."""

    text: str
    stem: bool
    weight: float
    edits: int | None = None

    @property
    def most_edits(self) -> int:
        return allowed_edits(self.text) if self.edits is None else self.edits


def allowed_edits(term: str) -> int:
    """Short entries must match as they are, longer ones with one or two edits."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class FuzzyLexicon:
    """The lexicon's trie intersected with Levenshtein automata, made deterministic as words are read.

    A state is a set of (trie node, letter still due, edits so far). Reading a letter follows it in the trie,
    substitutes it, skips it, skips letters of the trie, or swaps two neighbouring letters (one edit: the
    second is read first, the first is then due); states met before are looked up.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[list[int]] = [[]]
        self.edits = [0]
        for i, t in enumerate(terms):
            node, most = 0, t.most_edits
            self.edits[0] = max(self.edits[0], most)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.entry.append([]), self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], most)
            self.entry[node].append(i)
        self.alphabet = {c for t in terms for c in t.text}
        self.names: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []  # (edits, term) if the word ends here
        self.stem: list[tuple[int, int] | None] = []  # the same for terms that take any ending
        self.start = self._name({(0, ""): 0})

    def _name(self, places: dict[tuple[int, str], int]) -> int:
        todo = [(node, e) for (node, due), e in places.items() if not due]
        while todo:  # letters of the trie that the word leaves out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.edits[child] and e + 1 < places.get((child, ""), 9):
                    places[child, ""] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(places.items()))
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(key), self.moves.append({})
            ends = [(e, i) for (node, due), e in key if not due for i in self.entry[node] if e <= self.terms[i].most_edits]
            self.whole.append(min(ends, default=None))
            self.stem.append(min((x for x in ends if self.terms[x[1]].stem), default=None))
        return self.names[key]

    def _step(self, state: int, c: str) -> int:
        to: dict[tuple[int, str], int] = {}

        def reach(place: tuple[int, str], e: int) -> None:
            if e <= self.edits[place[0]] and e < to.get(place, 9):
                to[place] = e

        for (node, due), e in self.sets[state]:
            if due:
                if due == c:
                    reach((node, ""), e)
                continue
            reach((node, ""), e + 1)
            for letter, child in self.children[node].items():
                reach((child, ""), e + (letter != c))
                if letter != c and c in self.children[child]:
                    reach((self.children[child][c], letter), e + 1)
        return self._name(to)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest entry: fewest edits, then the first in the lexicon."""
        state, best = self.start, None
        for c in word:
            if c not in self.alphabet:
                c = "\0"
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._step(state, c)
            state = to
            if not self.sets[state]:
                return best
            if self.stem[state] is not None and (best is None or self.stem[state] < best):
                best = self.stem[state]
        end = self.whole[state]
        return min((x for x in (best, end) if x is not None), default=None)


#: Features of a document, see ``_Scorer``: those of plain hits only ever raise a score, the others may do either.
RAISING, FEATURES = 3, 5
#: What the weights are where the labelled texts don't tell: hits speak for label 1, quotation against it.
PRIOR = (-3.0, 2.0, 0.5, 0.25, -2.0, 0.0)


@dataclass(frozen=True)
class Hit:
    """A word of a text that is in the lexicon, or near it, and how much of it counts in its context."""

    edits: int
    quoted: bool
    addressed: bool
    counts: float


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Places of paired quotation marks: (opening, closing).

    A mark opens after a blank, an opening bracket or a dash and before what is no blank, and closes after what is no blank and before a blank, a closing bracket
    or punctuation; guillemets open and close by their form. A closing mark pairs with the last open one of its kind (double, single, guillemets), on
    the same line or another, if at most ``QUOTED_CHARS`` lie between; single marks pair on one line and within ``SINGLE_CHARS``. Inch marks, apostrophes and marks without a partner quote nothing.
    """
    spans, opened = [], {}
    for q in _QUOTES.finditer(text):
        i, c = q.start(), q.group()
        kind = "guillemet" if c in "«»‹›" else "single" if c in "'‘’" else "double"
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if kind == "guillemet":
            opens, closes = c in "«‹", c in "»›"
        else:
            opens = (not before or before.isspace() or before in "([{<-–—") and bool(after) and not after.isspace()
            closes = bool(before) and not before.isspace() and (not after or after.isspace() or not (after.isalnum() or after == "_"))
        if closes and not opens and kind in opened:
            start = opened.pop(kind)
            if i - start <= (SINGLE_CHARS if kind == "single" else QUOTED_CHARS) and not (kind == "single" and "\n" in text[start:i]):
                spans.append((start, i))
        elif opens:
            opened[kind] = i
    return spans


class _Scorer:
    """Context features of whole texts: what their hits count, and what share of it quotation, report and denial take."""

    def __init__(self, terms: list[Term], exempt: frozenset[str] = frozenset()):
        self.lexicon, self.exempt = FuzzyLexicon(terms), exempt
        self.seen: set[str] = set()
        self.found: dict[str, tuple[int, int]] = {}

    def matches(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """(edits, term) of the words met so far that match; empty if none of ``words`` does."""
        new = set(words) - self.seen
        if new:
            if len(self.seen) > _SEEN_LIMIT:
                self.seen, self.found = set(), {}
                new = set(words)
            for w in new:
                m = self.lexicon.match(w) if w not in self.exempt else None
                if m is not None:
                    self.found[w] = m
            self.seen |= new
        return {} if self.found.keys().isdisjoint(words) else self.found

    def hits(self, text: str, words: list[str]) -> list[Hit]:
        found = self.matches(words)
        if not found:
            return []
        out, low = [], text.lower()
        spans = quoted_spans(low)
        for i, m in enumerate(_WORD.finditer(low)):
            hit = found.get(m.group())
            if hit is None:
                continue
            quoted = any(s < m.start() and m.end() <= e for s, e in spans)
            off = TAKEN_OFF * (not REPORTS.isdisjoint(words[max(0, i - REPORT_WINDOW) : i])) + TAKEN_OFF * (not DENIALS.isdisjoint(words[max(0, i - DENIAL_WINDOW) : i]))
            addressed = not ADDRESS.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])
            out.append(Hit(hit[0], quoted, addressed, 0.0 if quoted else BY_EDITS[hit[0]] * (1 - off)))
        return out

    def features(self, text: str | None) -> tuple[np.ndarray, int, int, int]:
        """Of plain hits the one that counts most, what they count in all and per word; the share that is taken off; address."""
        x = np.zeros(FEATURES)
        words = _tokens(text) if text else []
        hits = self.hits(text, words) if words else []
        if not hits:
            return x, 0, 0, 0
        plain, full = sum(h.counts for h in hits), sum(BY_EDITS[h.edits] for h in hits)
        x[:] = (max(h.counts for h in hits), math.log1p(plain), math.log1p(100 * plain / len(words)), 1 - plain / full, float(any(h.addressed and h.counts > 0 for h in hits)))
        return x, len(hits), sum(1 for h in hits if h.edits), sum(1 for h in hits if h.quoted)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word beginnings of each labelled text, counted by label within the task."""
    for batch in batches:
        counts = [Counter(), Counter()]
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            words = {w for w in _tokens(text.as_py() or "") if len(w) > 2}
            counts[toxic.as_py()].update({(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) >= n})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            ["term", "stem", "toxic", "clean"],
        )


_FACTORS = np.random.default_rng(5).integers(0, 2**63, (2, MINIMA, 1), np.uint64) | np.uint64(1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash minima of each text's words; null for texts of few terms, which are no copies."""
    for batch in batches:
        sketches = []
        for text in batch.column(0):
            words = set(_tokens(text.as_py() or ""))
            sketch = None
            if sum(1 + sum(len(w) >= n for n in STEMS) for w in words if len(w) > 2) > FEW_TERMS:
                hashes = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.uint64)
                least = np.full(MINIMA, 2**32 - 1, np.uint32)
                for at in range(0, len(hashes), 4096):
                    least = np.minimum(least, ((hashes[at : at + 4096] * _FACTORS[0] + _FACTORS[1]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
                sketch = least.tobytes()
            sketches.append(sketch)
        yield pa.record_batch([batch.column(2), pa.array(sketches, pa.binary())], ["h", "sketch"])


def _copies(sketches: Iterable[tuple[int, bytes | None]]) -> dict[int, int]:
    """A group for each text: that of a text before it with mostly the same words; texts without a sketch are alone."""
    leaders: list[int] = []
    held = np.empty((0, MINIMA), np.uint32)
    buckets: dict[tuple[int, bytes], list[int]] = {}
    out = {}
    for group, (h, raw) in enumerate(sketches):
        out[h] = group
        if raw is None:
            continue
        keys = [(i, raw[i : i + 4 * BAND]) for i in range(0, 4 * MINIMA, 4 * BAND)]
        sketch = np.frombuffer(raw, np.uint32)
        met = np.array(sorted({x for k in keys for x in buckets.get(k, ())}), np.int64)
        share = (held[met] == sketch).mean(axis=1) if len(met) else np.zeros(1)
        if share.max() >= ALIKE:
            out[h] = leaders[met[share.argmax()]]
            continue
        if len(leaders) == len(held):
            held = np.concatenate([held, np.empty((max(64, len(held)), MINIMA), np.uint32)])
        held[len(leaders)] = sketch
        for k in keys:
            buckets.setdefault(k, []).append(len(leaders))
        leaders.append(group)
    return out


def _group_terms(copies: dict[int, int]):
    """Words and word beginnings of each text with the text's group of copies, once a group within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, h in zip(batch.column(0), batch.column(2).to_pylist(), strict=True):
                words = {w for w in _tokens(text.as_py() or "") if len(w) > 2}
                g = copies[h]
                found.update((w, False, g) for w in words)
                found.update((w[:n], True, g) for w in words for n in STEMS if len(w) >= n)
            rows = list(found)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], ["term", "stem", "copies"])

    return run


def _presence(candidates: list[tuple[str, bool]]):
    """Numbers of the candidate terms that each text has."""
    words = {t: i for i, (t, stem) in enumerate(candidates) if not stem}
    stems = {t: i for i, (t, stem) in enumerate(candidates) if stem}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                found = set()
                for w in set(_tokens(text.as_py() or "")):
                    found.add(words.get(w, -1))
                    found.update(stems.get(w[:n], -1) for n in STEMS if len(w) >= n)
                rows.append(sorted(found - {-1}))
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["found", "toxic", "h"])

    return run


def _groups(found: Iterable[set[int]]) -> list[int]:
    """A group for each text: that of the first text before it with mostly the same candidate terms.

    Texts with few candidates are groups of their own: they share a term because it tells, not as copies.
    """
    leaders: list[set[int]] = []
    by_term: dict[int, list[int]] = {}
    out = []
    for terms in found:
        if len(terms) <= FEW_TERMS:
            leaders.append(terms)
            out.append(len(leaders) - 1)
            continue
        shared = Counter(g for t in terms for g in by_term.get(t, ()))
        near = next((g for g, n in shared.most_common() if n >= 0.6 * (len(terms) + len(leaders[g]) - n)), None)
        if near is None:
            near = len(leaders)
            leaders.append(terms)
            for t in terms:
                by_term.setdefault(t, []).append(near)
        out.append(near)
    return out


def _joined(a: list[int], b: list[int]) -> list[int]:
    """Groups of texts that are linked by either grouping."""
    parent: dict[tuple[bool, int], tuple[bool, int]] = {}

    def root(x: tuple[bool, int]) -> tuple[bool, int]:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a, b, strict=True):
        parent[root((False, x))] = root((True, y))
    return [root((True, y))[1] for y in b]


def _lexicon(candidates: list[tuple[str, bool]], found: list[np.ndarray], toxic: np.ndarray, copies: list[int], clean: int) -> list[Term]:
    """Terms that texts of label 1 from several groups share, and hardly any other text has.

    The other words of a text that was copied often are shared by its copies only, which are one group, or few.
    ``copies`` are groups of texts by all their words; a text is of one group with those alike in either way.
    Of a word and its beginnings the longest that keeps nine tenths of the hits is taken, whole words first.
    """
    groups = _joined(_groups(set(f.tolist()) for f in found), copies)
    spread, hits, other = [set() for _ in candidates], Counter(), Counter()
    for f, g, y in zip(found, groups, toxic, strict=True):
        for t in f.tolist():
            (hits if y else other)[t] += 1
            if y:
                spread[t].add(g)
    good = {candidates[i]: hits[i] for i in range(len(candidates)) if len(spread[i]) >= LEAST_GROUPS and other[i] <= MOST_CLEAN * hits[i]}
    index = {c: i for i, c in enumerate(candidates)}
    n1, n0 = int((toxic == 1).sum()), max(clean, 1)
    taken: list[Term] = []
    covered: set[str] = set()
    in_order = sorted(good)
    for text, stem in sorted(good, key=lambda c: (len(c[0]), not c[1], c[0])):
        if any(text[:n] in covered for n in range(1, len(text) + 1)):
            continue
        family = []
        for i in range(bisect_left(in_order, (text, False)), len(in_order)):
            c = in_order[i]
            if not c[0].startswith(text):
                break
            if good[c] >= 0.9 * good[text, stem]:
                family.append(c)
        best = max(family, key=lambda c: (not c[1], len(c[0]), c[0]))
        covered.add(text)
        taken.append(Term(*best, math.log((hits[index[best]] + 0.5) / (n1 + 1)) - math.log((other[index[best]] + 0.5) / (n0 + 1))))
    return sorted(taken, key=lambda t: (-t.weight, t.text))


def _near_forms(terms: list[Term]):
    """Which texts have which term, or which word near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(terms)
        for batch in batches:
            rows = []
            for text, toxic, h in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _tokens(text.as_py() or "")
                found = scorer.matches(words)
                rows += [(found[w][1], found[w][0], w if found[w][0] else "", toxic, h) for w in set(words) & found.keys()]
            kinds = {"term": pa.int32(), "edits": pa.int32(), "form": pa.string(), "toxic": pa.int32(), "text": pa.int64()}
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    return run


def _misspellings(terms: list[Term], rows: list) -> tuple[list[Term], frozenset[str]]:
    """Terms with the edits that hold the same bar as the terms themselves, and words near a term that are none of it.

    ``rows``: (term, edits, form, toxic, text). Misspellings up to so many edits are allowed if hardly any clean
    text has one; a word near a term that clean texts use as much as others is a word of its own.
    """
    clean: dict[tuple[int, int], set[int]] = {}
    told: dict[int, set[int]] = {}
    forms: dict[str, list[set[int]]] = {}
    for r in rows:
        if r.toxic:
            told.setdefault(r.term, set()).add(r.text)
        elif r.edits:
            clean.setdefault((r.term, r.edits), set()).add(r.text)
        if r.edits:
            forms.setdefault(r.form, [set(), set()])[r.toxic].add(r.text)
    out = []
    for i, t in enumerate(terms):
        far, met = 0, set()
        for e in range(1, t.most_edits + 1):
            met |= clean.get((i, e), set())
            if len(met) > MOST_CLEAN * len(told.get(i, ())):
                break
            far = e
        out.append(Term(t.text, t.stem, t.weight, far))
    return out, frozenset(w for w, (n0, n1) in forms.items() if n0 and len(n0) >= len(n1))


def _newton(x: np.ndarray, y: np.ndarray, mean: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    w = mean.copy()
    penalty = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ (w - mean)), -5, 5)
    return w


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Logistic regression on the bounded sample with a ridge towards ``PRIOR``. What plain hits count only ever
    speaks for label 1: such features of negative weight are left out. The share taken off by quotation, report
    and denial, and address, have weights of either sign."""
    x = np.hstack([np.ones((len(x), 1)), x])
    used = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[used] = _newton(x[:, used], y, np.array(PRIOR)[used], ridge, steps)
        if (w[1 : 1 + RAISING] >= 0).all():
            return w
        used = [i for i in used if not 1 <= i <= RAISING or w[i] >= 0]


@dataclass
class ToxicityModel:
    terms: list[Term]
    weights: np.ndarray
    exempt: frozenset[str] = frozenset()


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn a lexicon and the weights of its context features from labelled rows.

    Rows of ``labels`` with a null id or label take no part; an id with several labels counts as 1 if one of
    them is 1. At most about ``MAX_TRAINING_DOCS`` ids are used, by a hash of the id; equal texts count once. A
    term is a candidate if the likelihood ratio against chance beats the number of terms tried and texts of label 1
    from several groups of near copies have it, and enters the lexicon if they still do where texts with mostly
    the same candidates are one group as well. Neither candidates nor terms are cut to a number or a length.
    Misspellings of a term are allowed as far as clean labelled texts hardly have any (``_misspellings``).
    Without any label 1 the lexicon is empty and every score is low.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max((F.col(label) == 1).cast("int")).alias("__y"))
    total = known.count()
    share = min(1.0, MAX_TRAINING_DOCS / max(total, 1))
    known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * share))  # bounded, so it may be broadcast
    sample = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "__id")
    sample = stored(sample.where("text is not null").groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("__y").alias("toxic")).select("text", "toxic", "h"), "toxic-sample")
    toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    clean = n - toxic
    if not toxic or not clean:
        return ToxicityModel([], np.array([math.log((toxic + 0.5) / (clean + 0.5)) if n else -6.0, *[0.0] * FEATURES]))
    counts = stored(sample.mapInArrow(_document_terms, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")), "toxic-terms")
    tried, base = max(counts.where("a + b >= 3").count(), 1), toxic / n
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    gain = a * F.log(a / (a + b) / base) + F.when(b > 0, b * F.log(b / (a + b) / (1 - base))).otherwise(0.0)
    bad = sample.where("toxic = 1")
    copies = _copies((r.h, r.sketch) for r in bad.mapInArrow(_sketches, "h long, sketch binary").orderBy("h").collect())  # bounded by MAX_TRAINING_DOCS
    spread = bad.mapInArrow(_group_terms(copies), "term string, stem boolean, copies long").groupBy("term", "stem").agg(F.count_distinct("copies").alias("groups")).where(F.col("groups") >= LEAST_GROUPS)
    telling = counts.where((a > b) & (gain >= math.log(tried) + 1)).join(spread, ["term", "stem"]).orderBy(F.desc(gain), "term", "stem")
    candidates = [(r.term, r.stem) for r in telling.select("term", "stem").collect()]  # bounded by the sample: each is in LEAST_GROUPS groups
    shown = sample.mapInArrow(_presence(candidates), "found array<int>, toxic int, h long").where((F.size("found") > 0) | (F.col("toxic") == 1)).orderBy("h").toArrow()  # bounded by MAX_TRAINING_DOCS
    alone = len(copies)  # clean texts are in no group of copies
    groups = [copies.get(h, alone + i) for i, h in enumerate(shown["h"].to_pylist())]
    terms = _lexicon(candidates, [f.values.to_numpy() for f in shown["found"]], shown["toxic"].to_numpy(), groups, clean)
    near = sample.mapInArrow(_near_forms(terms), "term int, edits int, form string, toxic int, text long").collect()  # bounded by MAX_TRAINING_DOCS: words near a term
    terms, exempt = _misspellings(terms, near)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(terms, exempt)
        for batch in batches:
            yield pa.record_batch([pa.array([scorer.features(t.as_py())[0].tolist() for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = sample.mapInArrow(rows, "x array<double>, y int").toPandas()  # bounded by MAX_TRAINING_DOCS
    return ToxicityModel(terms, _fit(np.array(got["x"].tolist()), got["y"].to_numpy(float)), exempt)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text; nothing is shuffled.

    Returns one row per input row: doc_id, score (0 to 1), predicted (1 if score >= threshold), n_hits,
    n_misspelled, n_quoted. A hit in paired quotation marks (``quoted_spans``) counts nothing, one after a word of report or
    denial half. Null and empty texts have no hits and get the score of a text without hits. Null ids and repeated rows
    are kept (the query's held_out is null for a null id); other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    terms, exempt, w = model.terms, model.exempt, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(terms, exempt)
        for batch in batches:
            got = [scorer.features(t.as_py()) for t in batch.column(1)]
            x = np.array([g[0] for g in got]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.record_batch(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(pa.array([g[i] for g in got], pa.int64()) for i in (1, 2, 3))],
                ["doc_id", "score", "predicted", "n_hits", "n_misspelled", "n_quoted"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int, n_hits long, n_misspelled long, n_quoted long")


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(bucket_of(id_col, 4) != 2)


def keep_clean(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold; null and empty texts stay."""
    bounded_batches(docs.sparkSession)
    terms, exempt, w = model.terms, model.exempt, model.weights
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(terms, exempt)
        for batch in batches:
            x = np.array([scorer.features(t.as_py())[0] for t in batch.column(at)]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
