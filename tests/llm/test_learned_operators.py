"""Collocations, recurrent language model and vector codes: against brute force and on edges."""

import hashlib
import math
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import phrases, queries, recurrent_lm, vector_codes, word_blocks
from tests.compare import connect, same

# --- word blocks ---------------------------------------------------------------------------------------------


def test_slices_cut_at_borders_only():
    raw = b"ab cd efgh ijk l"
    for size in range(1, 20):
        parts = list(word_blocks.slices(raw, b" ", size))
        assert b" ".join(parts) == raw
    assert list(word_blocks.slices(b"abcdef", b" ", 2)) == [b"abcdef"]


# --- collocations --------------------------------------------------------------------------------------------


def brute_collocations(docs, support, top, covered=100):
    count, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    count[lang, tuple(ws[i : i + k])] += 1
    held = {p: f for p, f in count.items() if f >= support}
    longest = {}
    for (lang, ws), f in held.items():
        for i in range(len(ws)):
            for j in range(i + 2, len(ws) + 1):
                if j - i < len(ws):
                    longest[lang, ws[i:j]] = max(longest.get((lang, ws[i:j]), 0), f)
    out = {}
    for (lang, ws), a in held.items():
        if len(ws) < 2 or 100 * longest.get((lang, ws), -1) >= covered * a:
            continue
        cuts = [(1000 * a * total[lang] // (held[lang, ws[:k]] * held[lang, ws[k:]]), k, held[lang, ws[:k]], held[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            rows.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(rows)


def found_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("block_words", "hashes", "words"), [(60, 2_000_000, 300_000), (1000, 0, 0)])
def test_collocations_equal_brute_force(spark, monkeypatch, block_words, hashes, words):
    """Small shards, whose share of the support is one or two occurrences, and nothing sent to the tasks."""
    monkeypatch.setattr(phrases, "MOST_CANDIDATES", hashes)
    monkeypatch.setattr(phrases, "MOST_WORDS", words)
    rng = np.random.default_rng(5)
    words = ["the", "Of", "é", "New", "york", "|", "\x1c", "a b", "ß", "x"]
    docs = [("".join(rng.choice(words) + str(rng.choice([" ", " ", "\t ", ". ", ",", "\r\n", " \x0b"])) for _ in range(rng.integers(0, 60))), str(rng.choice(["en", "de", "und"]))) for _ in range(120)]
    docs += [(None, "en"), ("", None), ("New york the the the the the the New york", None), ("x " * 700, "fr")] + [("alpha beta gamma delta epsilon zeta", "en")] * 9
    df = spark.createDataFrame([(t, lang, 1, "clash") for t, lang in docs], "text string, lang string, n long, word string").repartition(5)
    counts = phrases.phrase_counts
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a, **k: counts(*a, **k, block_words=block_words, shard_words=2 * block_words))
    want = brute_collocations(docs, 6, 40)
    assert found_rows(phrases.collocations(df, support=6, top=40)) == want and len(want) > 60
    assert phrases.collocations(df.where("false"), support=6).count() == 0
    assert phrases.collocations(df.limit(1), support=1000).count() == 0


def test_covered_phrases_go(spark):
    docs = spark.createDataFrame([("in spite of it", "en")] * 5 + [("in spite", "en")] * 2, "text string, lang string")
    assert {(r.phrase, r.a) for r in phrases.collocations(docs, support=5).collect()} == {("in spite", 7), ("in spite of it", 5)}


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(123456789012, 987654321098765, 123456789013, 523456789015), (10**12, 10**15, 10**12, 10**12), (7 * 10**11 + 1, 10**16 + 7, 7 * 10**11 + 3, 9 * 10**11 + 1)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases._floor_ratio(*(df[c] for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]


# --- recurrent language model --------------------------------------------------------------------------------


def small_vocabulary():
    return recurrent_lm.Vocabulary(list("abcdefgh"), [40, 20, 10, 9, 8, 7, 6, 5], 150, 14, 20)


def test_gradients_equal_differences():
    model = recurrent_lm.GatedModel(small_vocabulary(), state=5, classes=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    after, before, doc = recurrent_lm.lanes_of(rng.integers(0, 10, 40).astype(np.uint16), np.array([9, 7, 12, 1, 11]), 3)
    h, valid = rng.normal(0, 0.5, (3, 5)), doc >= 0

    def loss():
        held, gates, cand = model.read(before, h)
        return -model.predict(model.states(held, gates, cand).reshape(-1, 5)[valid.ravel()], after.ravel()[valid.ravel()], False)[0].sum()

    grads, _ = model.gradients(before, after, valid, h)
    for name, w in model.p.items():
        for i in rng.integers(0, w.size, 12):
            at, old = np.unravel_index(i, w.shape), w.flat[i]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7), name


def test_probabilities_sum_to_one():
    model = recurrent_lm.GatedModel(small_vocabulary(), state=4, classes=3)
    z = np.random.default_rng(2).normal(0, 1, (1, 4)).astype(np.float32)
    every = np.arange(10)
    assert np.exp(model.predict(np.repeat(z, 10, axis=0), every, False)[0]).sum() == pytest.approx(1, abs=1e-5)


def brute_score(model, numbers):
    """One document, step by step, in double precision."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    s, h, x, total = model.state, np.zeros(model.state), 0, 0.0
    for y in numbers:
        g = 1 / (1 + np.exp(-(p["into"][x, : 2 * s] + h @ p["gates"])))
        c = np.tanh(p["into"][x, 2 * s :] + (g[:s] * h) @ p["candidate"])
        h = (1 - g[s:]) * c + g[s:] * h
        z, k = np.append(h, 1), model.class_of[y]
        a = z @ p["to_class"]
        total += a[k] - np.log(np.exp(a).sum())
        of = np.flatnonzero(model.class_of == k)
        b = p["to_word"][of] @ z
        total += b[list(of).index(y)] - np.log(np.exp(b).sum())
        x = y
    return total / math.log(10)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_scores_equal_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    more = [(10_001, None), (10_002, ""), (10_003, "neverseen İ\x1cx the"), (None, "the of"), (10_004, "the \x0b of " * 5000), (5, "the")]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("n", docs.doc_id * 0).withColumn("word", docs.text)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts, v = recurrent_lm.number_texts(recurrent_lm.training_share(docs), vocabulary=50, block_words=20_000)
    model = recurrent_lm.train_model(texts, v, state=6, classes=7)
    count, learned = Counter(), [(i, t) for i, t in rows if i is not None and crc32(str(i).encode()) % 7 != 2]
    for _, t in learned:
        count.update(words_of(t))
    tokens, distinct = sum(count.values()) + len(learned), len(count) + 1
    assert (v.tokens, v.distinct, v.ends) == (tokens, distinct, len(learned))
    assert v.words == sorted(count, key=lambda w: (-count[w], w.encode()))[:50]
    number, want = {w: i + 1 for i, w in enumerate(v.words)}, []
    n_rare = sum(c for w, c in count.items() if w not in number)
    v_rare = len(count) - 50
    for i, t in rows:
        ws = words_of(t)
        base = sum(math.log10((count[w] + 1) / (tokens + distinct + 1)) for w in ws) + math.log10((len(learned) + 1) / (tokens + distinct + 1))
        inside = sum(math.log10((count[w] + 1) / (n_rare + v_rare + 1)) for w in ws if w not in number)
        want.append((-1 if i is None else i, len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, base, brute_score(model, [*(number.get(w, 51) for w in ws), 0]) + inside))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in recurrent_lm.score_texts(texts, model).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9) and g[4] == pytest.approx(w[4], rel=1e-4)


def test_thousands_of_words_have_a_vector_of_their_own(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 5, 6000, 5)) + f" once{i}") for i in range(10)]
    texts, v = recurrent_lm.number_texts(recurrent_lm.training_share(spark.createDataFrame(rows, "doc_id long, text string")))
    learned = {w for i, t in rows if crc32(str(i).encode()) % 7 != 2 for w in t.split()}
    assert set(v.words) == learned and len(learned) > 4800 and (v.rare_tokens, v.rare_distinct) == (0, 0)
    scores = recurrent_lm.score_texts(texts, recurrent_lm.train_model(texts, v, state=4)).collect()
    assert len(scores) == 10 and all(math.isfinite(r.score) and r.score < 0 for r in scores)


def test_words_are_numbered_without_a_loop_over_them():
    odd = [b"", b"  ", b"A b\x0b\tB  c ", b"\n", b"x", "é\xa0É q".encode(), b" x\x0cA"]
    found, n = word_blocks.numbered_words(odd, recurrent_lm._TABLE)
    want = [[w.encode() for w in words_of(t.decode())] for t in odd]
    assert [w[:-1] for w in found.to_pylist()] == [w for ws in want for w in ws] and n.tolist() == [len(ws) for ws in want]
    text, numbering = b" ".join(b"w%d" % (i * i % 9973) for i in range(200_000)), word_blocks.Numbering()

    def seconds(do):
        times = []
        for _ in range(5):
            begin = time.process_time()
            do()
            times.append(time.process_time() - begin)
        return min(times)

    assert seconds(lambda: word_blocks.numbered_words([text], recurrent_lm._TABLE)) < seconds(lambda: numbering.numbers(text.translate(recurrent_lm._TABLE).split()))


def test_lanes_hold_no_more_than_the_documents():
    lengths = np.array([200_000, *[3] * 1000])
    y = np.arange(lengths.sum()).astype(np.uint16)
    lanes, seen = recurrent_lm.Lanes(y, lengths, 1024), np.zeros(len(lengths), int)
    assert sum(x.size for x in vars(lanes).values()) < 3 * len(y)  # with every lane as long as the longest: 200 million
    for s, e, b in lanes.windows(16, 16 * 1024):
        after, before, doc = lanes.window(s, e, b)
        assert after.size <= 17 * 1024
        seen += np.bincount(doc[doc >= 0], minlength=len(lengths))
    assert (seen == lengths).all()


def test_large_outputs_stay_finite():
    model = recurrent_lm.GatedModel(small_vocabulary(), state=4, classes=3)
    model.p["to_word"] *= 300
    model.p["to_class"] *= 300
    z, y = np.random.default_rng(2).normal(0, 1, (40, 4)).astype(np.float32), np.arange(40) % 10
    got, grads, dz = model.predict(z, y, True)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    want, exact, dz64 = model.predict(z.astype(np.float64), y, True, True)
    assert got == pytest.approx(want, rel=1e-4, abs=1e-3) and dz == pytest.approx(dz64, rel=1e-2, abs=1e-1)
    assert all(np.isfinite(g).all() and g == pytest.approx(exact[k], rel=1e-2, abs=1e-2) for k, g in grads.items())


def test_model_reads_unseen_documents_better_than_counts(spark, data_dir):
    rows = recurrent_lm.score_documents(spark.read.parquet(f"{data_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")).where("held_out").collect()
    words, gained = sum(r.n_tokens for r in rows), sum(r.score - r.base_score for r in rows)
    assert gained / words > 0.02, "log10 a word"


def test_scoring_without_anything_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert recurrent_lm.score_documents(none).count() == 0
    (r,) = recurrent_lm.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (None, 3, 0, 0, 0.0) and r.score <= 0


# --- vector codes --------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for n in {len(v) for _, v, _ in kept}:
        cut = [p * n // parts for p in range(parts + 1)]
        mine = [(j, v) for j, (_, v, _) in enumerate(kept) if len(v) == n]
        first = sorted(mine, key=lambda r: (kept[r[0]][0] is None, kept[r[0]][0] or 0, r[1]))[:entries]
        books = [[v[cut[p] : cut[p + 1]] for _, v in first] for p in range(parts)]

        def near(v, p):
            return min((sum((a - b) ** 2 for a, b in zip(v[cut[p] : cut[p + 1]], c, strict=True)), k) for k, c in enumerate(books[p]))  # noqa: B023

        for _ in range(rounds):
            found = [[[] for _ in books[p]] for p in range(parts)]
            for _, v in mine:
                for p in range(parts):
                    found[p][near(v, p)[1]].append(v[cut[p] : cut[p + 1]])
            books = [[[sum(x) // len(some) for x in zip(*some, strict=True)] if some else c for some, c in zip(found[p], books[p], strict=True)] for p in range(parts)]
        digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for j, v in mine:
            best = [near(v, p) for p in range(parts)]
            out[j] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), digest)
    by_label = Counter()
    for j, (_, _, label) in enumerate(kept):
        by_label[label] += out[j][1]
    return sorted(((-1 if i is None else i), *out[j][:2], by_label[label], out[j][2]) for j, (i, _, label) in enumerate(kept))


def coded_rows(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 3, 16).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(100, 160)]  # many equal parts
    rows += [(i, rng.normal(0, 1, 16).tolist(), None) for i in range(40)] + [(7, rng.normal(0, 1, 16).tolist(), 1), (None, [0.5] * 16, 2)] + [(500 + i, [1.0] * 16, 1) for i in range(60)]
    rows += [(900 + i, rng.normal(0, 1, 11).tolist(), 0) for i in range(5)] + [(950, [1e9] * 16, 5), (951, [-1e9, *[0.0] * 15], 5), (960, [], 3), (961, [], 3)]
    rows += [(1, None, 1), (2, [1.0, None] * 8, 1), (3, [math.nan] * 16, 0), (4, [math.inf] * 16, 0)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, length int").repartition(3)
    assert coded_rows(vector_codes.compress_vectors(df)) == brute_codes(rows)
    assert vector_codes.compress_vectors(df.where("false")).count() == 0


def test_walk_shares_and_equals_plain_distances():
    rng = np.random.default_rng(8)
    parts = rng.integers(-2, 3, (9000, 5))
    parts, entries = np.unique(parts, axis=0).repeat(4, axis=0), rng.integers(-2, 3, (16, 5))
    for rows in (parts, parts[rng.permutation(len(parts))]):
        d = ((rows[:, None] - entries) ** 2).sum(axis=2)
        code, error = vector_codes.walk(rows, entries)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    assert vector_codes.shared_prefix(np.array([[1, 2, 3], [1, 2, 4], [0, 2, 4], [0, 2, 4]])).tolist() == [0, 2, 0, 3]


@pytest.mark.parametrize("name", ["op11_collocations", "op13_vector_codes"])
def test_learned_query_matches_duckdb(spark, data_dir, name):
    path = data_dir.replace("sf0.001", "sf0.01")
    same(queries.QUERIES[name](spark, path), connect(path), queries.ORACLES[name])
