"""Archives, vectors, audio and quality: against brute force, round trips and planted cases."""

import base64
import io
import math
import zipfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import audio_prints, neighbours, quality_lm, shared, warc_zip


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    links = spark.createDataFrame([*pairs, (None, 4)], "a long, b long")
    got = {r.node: r.component for r in shared.connected_components(links, "a", "b").collect()}
    assert {x: got.get(x, x) for x in want} == want
    assert shared.connected_components(links.where("false"), "a", "b").count() == 0


# --- WARC in ZIP ---------------------------------------------------------------------------------------------

PAGES = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://d e\r\nX: y", ""), (None, "http://e", "<p>é</p>"), (5, "http://f", "x" * 300_000), (0, "http://g", "<p>é</p>"), (6, "http://h", "a\r\n\r\nWARC/1.1 b")]


@pytest.mark.parametrize(("zip64", "index"), [(True, True), (False, True), (True, False)])
def test_archive_round_trip(spark, tmp_path, zip64, index):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, content string")
    got = {r.page_id: r for r in warc_zip.read_packages(shared.stored(warc_zip.write_packages(pages, str(tmp_path), package_bytes=5000, zip64=zip64, index=index), "p"), with_payload=True).collect()}
    assert set(got) == {p[0] for p in PAGES}
    groups = {}
    for i, _, html in PAGES:
        if i is not None:
            groups.setdefault(html or "", []).append(i)
    for i, _, html in PAGES:
        raw, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc_zip.base32_sha1(raw))
        first = min(groups[html or ""]) if i is not None else i
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    assert warc_zip.round_trip(pages.where("false")).count() == 0


def test_packages_are_plain_zip_files():
    for wide in (False, True):
        data = warc_zip.zip_stored([("archive/a.warc", [b"xy", b"z"]), ("indexes/b.cdxj", [b""])], wide)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.read("archive/a.warc") == b"xyz" and z.namelist()[1] == "indexes/b.cdxj"
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            z.writestr("archive/q.warc", b"hello")
            z.comment = b"a comment with PK\x05\x06 in it"
        raw = made.getvalue()
        read = lambda at, n: raw[at : at + n]  # noqa: E731, B023
        (m,) = warc_zip.read_directory(read, len(raw))
        at = warc_zip.data_start(read, m)
        assert raw[at : at + m.size] == b"hello"


def test_damage_is_not_passed_over(spark, tmp_path):
    data = bytearray(warc_zip.zip_stored([("archive/data.warc", [warc_zip.warc_record(1, "http://a", b"payload", None)])]))
    at = data.index(b"payload")
    data[at] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(data))
    rows = spark.createDataFrame([(f"file:{tmp_path}/a.zip",)], "path string")
    with pytest.raises(Exception, match="damaged payload"):
        warc_zip.read_packages(rows).collect()


def test_many_packages_and_many_shared_payloads(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 7}</p>" * 20) for i in range(200)] + [(None, "u", "<p>1</p>" * 20), (5, "u", "<p>5</p>" * 20)], "page_id long, url string, html string")
    want = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in warc_zip.round_trip(pages, package_bytes=500).collect())
    assert len(want) == 202 and sum(k == "response" for _, k, _ in want) == 9
    monkeypatch.setattr(warc_zip, "BROADCAST_IDS", 2)
    listed = shared.stored(warc_zip.write_packages(pages.repartition(1), str(tmp_path), package_bytes=500), "p")
    assert listed.count() > 60  # in one task
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in warc_zip.read_packages(listed).collect()) == want


# --- Nearest neighbours --------------------------------------------------------------------------------------


def exact_top(rows, top, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = sorted((-float(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in good if i != q and len(w) == len(v))
            if scored:
                out[q] = [i for _, i in scored[:top]]
    return out


def test_recall_over_many_start_blocks(spark):
    rng = np.random.default_rng(21)
    n, d = 3000, 24
    v = rng.normal(size=(n, d)).astype(np.float32) * rng.lognormal(0, 0.3, (n, 1)).astype(np.float32)  # some are many others' neighbours
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest_vectors(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    want = {q: set(np.argsort(-exact[q], kind="stable")[:20].tolist()) for q in range(0, n, 20)}
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies, more than a query asks for
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [1.0] * 15 + [float("nan")]), (2060, [1.0] * 3), (2061, [2.0, 0.5, 1.0]), (2062, [-1.0] * 3), (2180, [1.0]), (2080, []), (None, rows[3][1]), (2100, [None] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact_top(rows, 20, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values())) and len(want[2060]) == 2
    assert [i for i, _ in got[1000]][:20] == want[1000]
    vec = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v}
    assert all(abs(s - float(vec[q] @ vec[i])) < 1e-12 for q in got for i, s in got[q])
    assert neighbours.nearest_vectors(df.where("false")).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert sorted((r.query_id, r.rank) for r in neighbours.nearest_vectors(few).collect()) == [(0, 1), (0, 2)]


def test_rare_lengths_lose_no_neighbour(spark, monkeypatch):
    """A dozen vectors of another length among many blocks of others, and two whose length nobody else has but each other."""
    monkeypatch.setattr(neighbours, "START_BLOCK", 40)
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(1, 1500)] + [(20_000 + 20 * i, rng.normal(0, 1, 4).tolist()) for i in range(12)] + [(40_000, [1.0]), (40_020, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_vectors(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = dict(rows)
    for q in (i for i in vectors if i % 20 == 0):
        same = [i for i in vectors if i != q and len(vectors[i]) == len(vectors[q])]
        assert len(got[q]) == min(20, len(same))
        if len(same) < 20:
            want = sorted(same, key=lambda i: (-float(np.dot(vectors[i], vectors[q])), i))
            assert [v for _, v, _ in sorted(got[q])] == want


def test_walks_that_end_early_are_completed(spark, monkeypatch):
    """A graph without edges: all queries are held against all vectors, in blocks."""
    monkeypatch.setattr(neighbours, "greedy_search", lambda graph, codes, queries: queries.select("query", queries["query"].alias("node"), F.lit(0.0).alias("score")))
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(200)] + [(1000 + i, [9.0] * 6) for i in range(70)]
    got = {}
    for r in neighbours.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    vectors = dict(rows)
    for q in (i for i in vectors if i % 20 == 0):
        want = sorted((i for i in vectors if i != q), key=lambda i: (-sum(a * b for a, b in zip(vectors[q], vectors[i], strict=True)), i))[:20]
        assert [v for _, v in sorted(got[q])] == want



# --- Audio ---------------------------------------------------------------------------------------------------


def test_alignment_finds_planted_offsets(spark):
    rng = np.random.default_rng(2)
    tones = audio_prints._tones()
    song = lambda n: rng.integers(0, len(tones), n)
    a, b, c = song(120), song(150), song(90)
    noisy = np.clip(tones[b].astype(int).ravel() + rng.normal(0, 6, tones[b].size), 0, 255).astype(np.uint8)
    shifted = np.concatenate([song(13), a[20:100], song(10)])
    rows = [(0, tones[a].tobytes()), (50, noisy.tobytes()), (1, tones[shifted].tobytes()), (2, tones[b].tobytes()), (3, tones[c].tobytes()), (100, tones[c].tobytes()), (4, tones[c].tobytes()), (150, None), (5, b""), (6, b"\x80" * 100), (None, tones[c].tobytes()), (200, b"\x80" * 5000)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "rec_id long, pcm binary, votes int")
    got = {r.rec_id: r for r in audio_prints.align(audio_prints.fingerprints(df)).collect()}
    assert len(got) == len(rows)
    assert (got[0].match_id, got[0].shift) == (1, (13 - 20) * 2) and got[0].bit_error <= 0.15
    assert (got[50].match_id, got[50].shift) == (2, 0)
    assert got[100].first_copy == 3 == got[4].first_copy and got[100].match_id is None
    assert got[150].n_codes == got[5].n_codes == got[6].n_codes == 0 and got[150].first_copy is None
    assert audio_prints.align(audio_prints.fingerprints(df.where("false"))).count() == 0


def test_short_recordings_align_by_a_shared_passage(spark):
    rng = np.random.default_rng(8)
    tones = audio_prints._tones()
    rows, want = [], {}
    for k, n in enumerate(n for n in (16, 18, 20, 22, 25, 30) for _ in range(5)):
        passage, at = rng.integers(0, len(tones), n), int(rng.integers(1, 40))
        longer = np.concatenate([rng.integers(0, len(tones), at), passage, rng.integers(0, len(tones), 30)])
        rows += [(50 * k, tones[passage].tobytes()), (50 * k + 1, tones[longer].tobytes())]
        want[50 * k] = (50 * k + 1, 2 * at)
    df = spark.createDataFrame(rows, "rec_id long, pcm binary")
    got = {r.rec_id: (r.match_id, r.shift) for r in audio_prints.align(audio_prints.fingerprints(df)).where("rec_id % 50 = 0").collect()}
    assert got == want


def test_all_partners_and_offsets_are_returned(spark):
    rng = np.random.default_rng(9)
    tones = audio_prints._tones()
    song = lambda n: rng.integers(0, len(tones), n)
    p, q = song(30), song(30)
    query = np.concatenate([p, song(10), q])
    twice = np.concatenate([song(5), p, song(17), p, song(3)])
    rows = [(0, query), (1, twice), (2, np.concatenate([song(9), q])), (2, np.concatenate([p, song(4)])), (3, song(60)), (50, song(40))]
    df = spark.createDataFrame([(i, tones[x].tobytes()) for i, x in rows], "rec_id long, pcm binary")
    got = audio_prints.align(audio_prints.fingerprints(df)).collect()
    found = sorted((r for r in got if r.rec_id == 0), key=lambda r: r.match_rank)
    assert {(r.match_id, r.shift) for r in found} == {(1, 2 * 5), (1, 2 * 52), (2, 2 * (9 - 40)), (2, 0)}
    assert [r.match_rank for r in found] == [1, 2, 3, 4] and [r.votes for r in found] == sorted((r.votes for r in found), reverse=True)
    assert sorted(r.rec_id for r in got if r.rec_id) == [1, 2, 2, 3, 50] and all(r.match_id is None for r in got if r.rec_id)


def test_landmarks_that_no_query_has_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(12)
    tones = audio_prints._tones()
    song = lambda n: rng.integers(0, len(tones), n)
    passages, rows = [song(25) for _ in range(4)], []
    for i in range(200):
        rows.append((i, tones[np.concatenate([song(int(rng.integers(5, 60))), passages[i % 4] if i % 9 == 5 or i % 50 == 0 else song(25), song(20)])].tobytes()))
    prints = audio_prints.fingerprints(spark.createDataFrame(rows, "rec_id long, pcm binary"))
    codes, marks = {r.rec_id: np.frombuffer(r.codes, np.uint32) for r in prints.collect()}, {}
    for i, c in codes.items():
        pairs = list(zip(c[: -audio_prints.STRIDE].tolist(), c[audio_prints.STRIDE :].tolist(), strict=True))
        marks[i] = [(m, at) for at, m in enumerate(pairs) if at == 0 or pairs[at - 1] != m]
    votes = Counter((q, o, to - at) for q in range(0, 200, 50) for o in codes if o != q for m, at in marks[q] for k, to in marks[o] if m == k)
    want = set()
    for (q, o, d), n in votes.items():
        a, b = codes[q][max(0, -d) :], codes[o][max(0, d) :]
        size = min(len(a), len(b))
        w = max(min(16, size), size // 4)
        wrong = [int(x).bit_count() for x in a[:size] ^ b[:size]]
        if n >= audio_prints.LEAST_VOTES and min(sum(wrong[i : i + w]) for i in range(size - w + 1)) / (32 * w) <= audio_prints.MOST_ERRORS:
            want.add((q, o, d, n))
    written = {}
    keep = audio_prints.stored

    def stored(df, name):
        out = keep(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(audio_prints, "stored", stored)
    got = audio_prints.align(prints).where("match_id is not null").collect()
    assert len(want) > 10 and {(r.rec_id, r.match_id, r.shift, r.votes) for r in got} == want and len(got) == len(want)
    asked = {m for q in range(0, 200, 50) for m, _ in marks[q]}
    shared = sum(m in asked for i in marks for m, _ in marks[i])
    assert shared <= written["audio-marks"] < shared + 0.05 * sum(map(len, marks.values()))


def test_recording_ids_are_unique_and_ask_for_every_turn(spark):
    turns = spark.range(60).selectExpr("id AS conv_id").crossJoin(spark.range(130).selectExpr("id AS turn")).withColumn("text", F.lit("a"))
    ids = [r.rec_id for r in audio_prints.sung_texts(turns).select("rec_id").collect()]
    assert len(set(ids)) == len(ids) == 60 * 130
    assert {i % audio_prints.TURNS for i in ids if i % 50 == 0} == set(range(130))


def test_fingerprint_areas_equal_plain_sums():
    image = np.random.default_rng(4).random((40, 12)).astype(np.float32)
    codes = audio_prints.codes_of(image)
    assert len(codes) == 40 - audio_prints.SPAN + 1
    kind, y, h, w = audio_prints._FILTERS[0]
    assert kind == "sum"
    for t in (0, 7, 24):
        a, b = image[t : t + w, y : y + h].sum(), image[t : t + w].sum() * h / 12
        level = sum(math.log((a + 0.05) / (b + 0.05)) > x for x in audio_prints._LEVELS)
        assert int(codes[t]) >> 30 == level ^ (level >> 1)


# --- Quality -------------------------------------------------------------------------------------------------


def brute_model(texts, alphabet):
    """The same model by dictionaries: counts, continuation counts, discounts, recursion."""
    table, n = quality_lm._table_of(alphabet), quality_lm.ORDER
    seq = lambda t: [quality_lm.EDGE] * (n - 1) + quality_lm._symbols(quality_lm._points(t), table).tolist()
    counts = [{} for _ in range(n + 1)]
    for t in texts:
        s = seq(t)
        for i in range(n - 1, len(s)):
            g = tuple(s[i - n + 1 : i + 1])
            counts[n][g] = counts[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def discounts(c):
        m = [sum(v == i for v in c.values()) for i in range(5)]
        if not m[1]:
            return [0.5, 0.75, 0.9]
        y = m[1] / (m[1] + 2 * m[2])
        raw = [1 - 2 * y * m[2] / m[1], 2 - 3 * y * m[3] / m[2] if m[2] else 1.0, 3 - 4 * y * m[4] / m[3] if m[3] else 1.5]
        return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    ds = [discounts(c) for c in counts]

    def p(g):
        k = len(g)
        if not k:
            return 1 / quality_lm.SYMBOLS
        d = lambda v: ds[k][min(v, 3) - 1]
        followers = {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        total = sum(followers.values())
        if not total:
            return p(g[1:])
        own = counts[k].get(g, 0)
        return (own - d(own) if own else 0) / total + sum(d(v) for v in followers.values()) / total * p(g[1:])

    return lambda t: math.exp(-sum(math.log(p(tuple(seq(t)[i : i + n]))) for i in range(len(seq(t)) - n + 1)) / len(quality_lm._points(t)))


def test_perplexity_equals_brute_force(spark):
    texts = ["the cat sat on the mat.", "a cat and a hat", "the hat sat", "that mat", "Über den Hut"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(10, "zzz qqq!! ## 77", "en"), (11, None, "en"), (12, "", None), (13, "the cat", None), (None, "the hat", "xx"), (1, texts[1], "en")]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, lang string, perplexity double")
    trusted = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (None,), (999,)], "doc_id long")
    got = quality_lm.quality_by_perplexity(docs, trusted, quantile=0.99).collect()
    assert len(got) == len(rows)
    apart = {r.doc_id for r in trusted.where(quality_lm.held_apart()).collect()}
    assert 0 < len(apart & set(range(5))) < 5
    learned = [t for i, t, _ in rows if i in range(5) and i not in apart]
    alphabet = quality_lm.frequent_characters(spark.createDataFrame([(t,) for t in learned], "text string"))
    ppl = brute_model(learned, alphabet)
    by_text = {(i, lang): t for i, t, lang in rows}
    for r in got:
        t = by_text[r.doc_id, r.lang]
        assert (r.perplexity is None) if not t else abs(r.perplexity / ppl(t) - 1) < 1e-4, t
        assert r.keep == (r.perplexity is None or r.perplexity <= r.threshold)
    assert not next(r for r in got if r.doc_id == 10).keep
    none = quality_lm.quality_by_perplexity(docs, trusted.where("false")).collect()
    assert all(r.keep and r.threshold is None for r in none)
    assert quality_lm.quality_by_perplexity(docs.where("false"), trusted).count() == 0


def test_rare_characters_are_spelled():
    table = quality_lm._table_of(["a", "語"])
    spell = lambda c, n: [quality_lm.DIGIT + int(d, 16) for d in f"{ord(c):0{n}x}"]
    want = [17, *spell("日", 4), 18, *spell("😀", 6), 17, *spell("é", 4)]
    assert quality_lm._symbols(quality_lm._points("A日語😀aÉ"), table).tolist() == want


def test_scripts_without_latin_letters_are_judged_by_their_letters(spark):
    rng = np.random.default_rng(5)
    words = [rng.choice(list("日本語書読行見食時間大学生人"), 4).tolist() for _ in range(30)]
    clean = lambda: "".join("".join(words[i]) for i in rng.integers(0, 30, 40))
    junk = lambda: "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 160))
    rows = [(i, clean(), "ja") for i in range(60)] + [(100 + i, junk(), "ja") for i in range(10)] + [(200 + i, clean(), "ja") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_lm.quality_by_perplexity(docs, docs.where("doc_id < 60").select("doc_id")).collect()}
    assert not any(got[100 + i].keep for i in range(10)) and all(got[200 + i].keep for i in range(10))
    assert min(got[100 + i].perplexity for i in range(10)) > 3 * max(got[200 + i].perplexity for i in range(10))
    assert got[0].n_chars == 160


def test_probabilities_of_a_context_sum_to_one(spark):
    t = spark.createDataFrame([("abcabdabe" * 3,)], "text string")
    alphabet = quality_lm.frequent_characters(t)
    counts = quality_lm.gram_counts(t, alphabet)
    grams = counts.select((F.shiftright("gram", 6)).alias("c")).distinct().limit(5)
    every = grams.select(F.explode(F.expr("transform(sequence(0, 63), x -> shiftleft(c, 6) + x)")).alias("gram"))
    sums = quality_lm.log_probabilities(counts, every).groupBy(F.shiftright("gram", 6)).agg(F.sum(F.exp("logp")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-4 for r in sums)


def cut_by_brute_force(rows, least):
    """Texts without the lines of any run that stands at an earlier place; None for those of which nothing is left."""
    from tests.llm.test_text_operators import brute_lines

    return {i: t for i, t in brute_lines(rows, least).items() if t.split() or not (dict(rows)[i] or "").split()}


def test_pipeline_stages_on_a_few_documents(spark, tmp_path):
    import corpus_pipeline

    passage = "this passage of many words is found again and again in this small corpus and it is long enough to be cut. "
    base = [f"plain{i}" for i in range(40)]
    docs = [(i, " ".join(f"{w}{i}" for w in base) + ".", "en", f"s{i % 2}", 1) for i in range(60)]
    docs += [(100, passage + "first.", "en", "s0", 1), (101, passage + "second one.", "en", "s0", 1)]
    docs += [(110 + k, " ".join(f"near{j if j != k else 99}" for j in range(60)) + ".", "en", "s1", 1) for k in range(3)]
    docs += [(200 + i, f"dreadful{i} " + " ".join(f"q{j}z{i}" for j in range(10)) + " blasted", "en", "s1", 1) for i in range(40)]
    docs += [(300, None, None, None, None), (301, "", "en", None, 0), (302, docs[0][1], "en", "s1", 1), (303, "very long text " * 20_000, "en", "s1", 1), (None, "a row without an id", "en", "s0", 1)]
    labels = [(i, int(i >= 200)) for i, *_ in docs if i is not None and (i < 60 or 200 <= i < 240)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = shared.stored(stage(spark, kept, str(tmp_path)), "test-stage")
        seen[name] = kept.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    everything = {d[0] for d in docs}
    assert ids["toxicity"] == everything - set(range(200, 240))
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert texts[100] == passage + "first." and texts[101] == "second one." and texts[300] is None and texts[None] == "a row without an id"
    want = cut_by_brute_force([(r.doc_id, r.text) for r in seen["toxicity"] if r.doc_id is not None], 20)
    assert {i: t for i, t in texts.items() if i is not None and t is not None} == want
    assert ids["line_dedup"] == ids["toxicity"] - {302}  # nothing was left of the exact copy
    assert ids["near_duplicates"] == ids["line_dedup"] - {111, 112}
    assert ids["mixing"] == ids["byte_bpe"] == ids["near_duplicates"]
    assert len(seen["byte_bpe"]) == len(seen["mixing"])
    assert all(set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for r in seen["mixing"])
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    tokens = sorted((r.doc_id or -1, len(enc.encode_ordinary(r.text or ""))) for r in seen["mixing"])
    assert sorted((r.doc_id or -1, r.n_tokens) for r in seen["byte_bpe"]) == tokens


def test_pipeline_of_an_empty_table_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, mix_key string, runs int"
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
