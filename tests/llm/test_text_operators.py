"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import base64
import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, language_id, line_dedup, mixing, near_dedup, shared, toxicity

DOCS = "doc_id long, text string, lang string, source string, rep long, score double"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- MinHash near-dedup --------------------------------------------------------------------------------------


def brute_groups(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = near_dedup.words_of(text or "")
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in parent}


def test_near_dedup_equals_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, "one two")]
    for k in range(9, 40):  # a chain: each text is near the one before it only
        base = [*base[1:], f"w{k + 60}"] if k % 3 else [x + "x" if i % (k + 2) == 0 else x for i, x in enumerate(base)]
        rows.append((k, " ".join(base)))
    rows.append((50, "long " * 30_000))
    want = brute_groups(rows, 2, 80)
    extra = frame(spark, [(i, t, "en", "s", i, 0.5) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(extra, words=2).collect()}
    assert got == want
    kept = {r.doc_id for r in near_dedup.keep_first_of_groups(extra, words=2).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_dedup_in_many_small_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 200)
    rng = np.random.default_rng(12)
    rows = []
    for family in range(4):  # members are 0.65 to 0.95 alike: many share buckets, some are linked by others only
        base = [f"f{family}w{i}" for i in range(50)]
        for k in range(25):
            words = list(base)
            for at in rng.choice(50, int(rng.integers(1, 6)), replace=False):
                words[at] = f"x{rng.integers(30)}"
            rows.append((100 * family + k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_groups(frame(spark, rows), words=2).collect()}
    assert got == brute_groups(rows, 2, 80)


def test_a_join_with_hot_keys_is_a_join(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 3, i) for i in range(300)] + [(None, 1)], "k long, v long")
    per = rows.where("k IS NOT NULL AND k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    want = sorted(tuple(r) for r in rows.join(per.drop("n"), "k").collect())
    for bound in (0, 50, 1000):
        assert sorted(tuple(r) for r in shared.join_per_key(rows, per, "k", "n", 301, bound).collect()) == want
    two, per2 = rows.withColumn("h", F.col("v") % 2), rows.where("k IS NOT NULL").groupBy("k", (F.col("v") % 2).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    want = sorted(tuple(r) for r in two.join(per2.drop("n"), ["k", "h"]).select("k", "v", "h", "top").collect())
    for bound in (0, 30, 1000):
        assert sorted(tuple(r) for r in shared.join_per_key(two, per2, ["k", "h"], "n", 301, bound).collect()) == want


def test_near_dedup_of_repeated_and_null_ids_and_empty_table(spark):
    rows = frame(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (2, "x y z"), (None, None)])
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicate_groups(rows, words=2).collect())
    assert got == [(0, 0, True), (0, 0, True), (2, 2, True), (2, 2, True), (2, 2, True)]
    assert near_dedup.near_duplicate_groups(rows.where("false"), words=2).count() == 0


def test_words_split_at_six_blanks_only():
    assert near_dedup.words_of("A\x1cb c d\x0be") == ["a\x1cb c", "d", "e"]
    assert near_dedup.words_of("ÄB c") == ["Äb", "c"]


# --- Toxicity ------------------------------------------------------------------------------------------------


def test_fuzzy_lexicon_equals_brute_force():
    def distance(a, b):  # swapping two neighbours is one edit
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = [toxicity.Term("scum", False, 1.0), toxicity.Term("idiot", False, 1.0), toxicity.Term("worthless", False, 1.0), toxicity.Term("lowei", True, 1.0)]
    lexicon = toxicity.FuzzyLexicon(terms)
    words = ["scum", "scums", "idiot", "idoit", "idiott", "id1ot", "idit", "worthles", "wrothless", "worth", "lowei", "loweischaft", "lwei", "loweeischaft", "", "zzz", "idiotidiot", "idito", "wortlhess", "owrthlses", "olwei", "diiot"]
    for w in words:
        best = []
        for i, t in enumerate(terms):
            ends = range(len(w) + 1) if t.stem else [len(w)]
            d = min(distance(w[:e], t.text) for e in ends)
            if d <= toxicity.allowed_edits(t.text):
                best.append((d, i))
        assert lexicon.match(w) == min(best, default=None), w


def test_toxicity_learns_and_handles_odd_rows(spark):
    bad, fill = ["grumble", "blasted", "rotten"], [f"word{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(300):
        words = [fill[(i * 7 + k) % 40] for k in range(12)]
        toxic = i % 5 == 0
        if toxic:
            words[3] = bad[i % 3]
        docs.append((i, " ".join(words), "en", "s", i, 0.0))
        labels.append((i, int(toxic)))
    docs += [(900, None, None, None, 1, 0.0), (901, "", None, None, 1, 0.0), (902, "word1 grumblle word2 " * 3, None, None, 1, 0.0), (None, "word1", None, None, 1, 0.0), (903, "word " * 50_000 + "rotten", None, None, 1, 0.0)]
    labels += [(None, 1), (5, None), (77777, 1)]
    d, lab = frame(spark, docs, DOCS), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.learn_toxicity(d, toxicity.training_labels(lab))
    assert {t.text for t in model.terms} == set(bad)
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, model).collect()}
    assert len(got) == len(docs)
    held = [i for i in range(300) if i % 5 == 0 or i % 7 == 0]
    assert all(got[i].predicted == (i % 5 == 0) for i in held)
    assert got[902].n_misspelled == 3 and got[900].score == got[901].score < 0.3
    kept = {r.doc_id for r in toxicity.keep_clean(d, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    empty = toxicity.learn_toxicity(d, lab.where("false"))
    assert not empty.terms and toxicity.score_toxicity(d.where("false"), empty).count() == 0


# --- Byte-level BPE ------------------------------------------------------------------------------------------


LONG_INSULT = "unmitigatedlydreadfulandwhollyrottenperson"


def taught(spark):
    fill = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = [fill[(i * 7 + k) % 40] for k in range(12)]
        if i % 5 == 0:
            words[3] = ("blastard", LONG_INSULT, "scumbag")[i % 3]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return toxicity.learn_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))


def test_quotation_marks_pair():
    quoted = lambda t: [t[a + 1 : b] for a, b in toxicity.quoted_spans(t)]
    assert quoted('It is 5" wide, you idiot, and 7" tall.') == []
    assert quoted("She called him 'idiot' yesterday") == ["idiot"]
    assert quoted('he said "you\nidiot", then left') == ["you\nidiot"]
    assert quoted("don't, dogs' idiot isn't") == [] and quoted("'tis an idiot\nof the dogs'") == []
    assert quoted("er sagte „Idiot“ und “fool”, « sot » (\"ass\")") == ["Idiot", "fool", " sot ", "ass"]
    assert quoted('"open idiot') == [] and quoted('idiot"') == [] and quoted('"' + "x" * 600 + '"') == [] and quoted("") == []
    assert quoted('a "b" 5" c "d"') == ["b", "d"]


def test_quotation_and_misspelling_change_the_score(spark):
    model = taught(spark)
    assert {t.text for t in model.terms} == {"blastard", "scumbag", LONG_INSULT}  # whole words, however long
    texts = {
        "plain": "you are a blastard word1 word2", "quoted": 'the note said "you are a blastard" word1 word2', "german": "er sagte „blastard“ word1 word2", "misspelled": "you are a balstrad word1 word2",
        "reported": "they call you this: the word blastard word1 word2", "long": f"word3 {LONG_INSULT} word4", "long misspelled": f"word3 {LONG_INSULT[:9]}{LONG_INSULT[10:]} word4", "both": 'he wrote "blastard" and then he was a blastard himself', "clean": "word1 word2",
    }
    rows = list(enumerate([*texts.values(), texts["plain"]]))
    got = [r.score for r in toxicity.score_toxicity(frame(spark, rows), model).orderBy("doc_id").collect()]
    by = dict(zip(texts, got, strict=False))
    assert min(by[k] for k in ("plain", "misspelled", "long", "long misspelled", "both")) >= 0.3 > max(by[k] for k in ("quoted", "german", "clean"))
    assert by["reported"] < by["plain"] and by["quoted"] <= by["clean"] and got[-1] == by["plain"]


def test_words_near_a_term_that_clean_texts_use_are_no_misspellings(spark):
    rows = [(i, f"word{i % 9} word{i % 7} " + ("clown" if i % 4 == 0 else "crown" if i % 4 == 1 else "plain"), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert [(t.text, t.edits) for t in model.terms] == [("clown", 0)] and "crown" in model.exempt
    assert [r.predicted for r in toxicity.score_toxicity(docs, model).orderBy("doc_id").collect()] == [r[2] for r in rows]


def test_copies_of_one_long_toxic_text_do_not_crowd_out_terms(spark):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    common = [word(6) for _ in range(400)]
    long_text = [word(10) for _ in range(2200)]
    rows = []
    for i in range(60):  # near copies: each has 20 words changed
        words = list(long_text)
        for at in rng.choice(len(words), 20, replace=False):
            words[at] = word(10)
        rows.append((i, " ".join(words), 1))
    for i in range(40):
        rows.append((100 + i, " ".join([*rng.choice(common, 30), "zorblax", *rng.choice(common, 30)]), 1))
    for i in range(200):
        rows.append((200 + i, " ".join(rng.choice(common, 60)), 0))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(d, lab)
    assert {t.text for t in model.terms} == {"zorblax"}
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, model).collect()}
    assert all(got[100 + i] == 1 for i in range(40)) and not any(got[200 + i] for i in range(200))


def test_bpe_equals_the_library_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "a" * 3000, "aab" * 300, " \n\t x  y   ", "don't I'LL 12½ ²", "日本語のテキスト" * 9, "!" * 500, "\x1c a\x85b", "über größe été", "x" * 95 + "é", "abcabd" * 40, "hello hello", "hello hello"]
    rows = frame(spark, [(i if i else None, t, "l", "s", i, 1.0) for i, t in enumerate(texts)], DOCS)
    got = bpe.encode_bytes(rows, path, public_tokenizers.PATTERN, with_ids=True, with_decoded=True).collect()
    assert len(got) == len(texts)
    for r, t in zip(sorted(got, key=lambda r: r.doc_id or 0), texts, strict=True):
        ids = enc.encode_ordinary(t or "")
        assert (r.ids, r.n_tokens, bytes(r.decoded)) == (ids, len(ids), (t or "").encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_bytes(rows.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_remembered_and_decoded_by_their_ids():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = bpe.PieceTable(f.read())
    db, sent = table.db, []

    class Counted:
        def register(self, name, rows):
            sent.append(rows.num_rows * (name == "pieces"))
            return db.register(name, rows)

        def __getattr__(self, name):
            return getattr(db, name)

    table.db = Counted()
    parts = [{f"q{i:x}z" for i in range(k * 90_000, (k + 1) * 90_000)} for k in range(3)]
    for part in parts:
        table.learn(part)
    before = sum(sent)
    table.learn(parts[0])
    assert before > 260_000 and sum(sent) == before, "pieces met 180,000 others ago are not encoded again"
    assert parts[0] <= table.known.keys() and not table.changed
    token = table.ranks[b" the"]
    db.execute(f"UPDATE tokens SET hex = '58' WHERE id = {token}")
    table.known.clear(), table.older.clear()
    table.learn({" the", " them"})
    assert table.changed[" the"] == b"X" and table.known[" the"] == str(token).encode()


def test_bpe_of_long_texts_and_copies(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_text, run = "Many words of a very long text, über und über. " * 30_000, "xyzzy" * 700
    rows = frame(spark, [(i, t) for i, t in enumerate([long_text, "a", long_text, run, "a", None, run + "!"])])
    for r in bpe.encode_bytes(rows, path, public_tokenizers.PATTERN).join(rows, "doc_id").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# --- Language ------------------------------------------------------------------------------------------------


def test_language_is_told_on_held_out_rows(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    model = language_id.learn_languages(language_id.training_rows(docs))
    held = docs.where("pmod(crc32(cast(doc_id AS string)), 3) = 1").join(language_id.predict_language(docs, model).select("doc_id", "lang_pred"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    odd = frame(spark, [(1, None, None, "s", 1, 1.0), (2, "", "en", "s", 1, 1.0), (3, "12 !? \n", "en", "s", 1, 1.0), (None, "the and of " * 40_000, None, "s", 1, 1.0)], DOCS)
    got = {r.doc_id: r for r in language_id.predict_language(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (1, 2, 3))
    assert got[None].lang_pred in model.languages and 0 <= got[None].score <= 1
    none = language_id.learn_languages(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict_language(odd, none).collect()} == {"und"}


def plain_grams(text):
    """Slots of letter n-grams, one by one in whole numbers; runs of other characters are one break."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    while "  " in letters:
        letters = letters.replace("  ", " ")
    out = []
    for n in (1, 2, 3):
        for gram in (letters[i : i + n] for i in range(len(letters) - n + 1)):
            if gram != " ":
                h = 0
                for c in gram:
                    h = ((h ^ h >> 15) * 0x9E3779B1 + (0 if c == " " else ord(c))) % 2**32
                k = (h + n * 7919) * 0x85EBCA6B % 2**32
                out.append((k ^ k >> 13) * 0xC2B2AE35 % 2**32 >> 19)
    return out


def test_language_equals_brute_force_cosines(spark):
    texts = {"aa": ["abra kadabra", "abba baba"], "bb": ["lorem ipsum dolor", "dolor sit"], "cc": ["zig zag zug"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn_languages(train)
    for t in (" Lorem  KADABRA, zig!", "a", "Ü b-ß"):
        assert {i: n for i, n in enumerate(language_id.ngram_counts(t)) if n} == dict(Counter(plain_grams(t)))
    grams = [set(plain_grams(t)) for _, t, _ in rows]
    idf = lambda g: np.log((1 + len(rows)) / (1 + sum(g in s for s in grams))) + 1

    def vector(t):
        g = plain_grams(t)
        v = {x: np.log1p(g.count(x)) * idf(x) for x in set(g)}
        size = sum(x * x for x in v.values()) ** 0.5
        return {k: x / size for k, x in v.items()}

    asked = ["abra dolor", "zug zug abba", "Lorem KADABRA zig", "abra kadabra", "abra kadabra"]
    got = language_id.predict_language(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, asked, strict=True):  # up to four texts of a language are centroids of their own
        q, best = vector(t), []
        for _, x, lang in rows:
            v = vector(x)
            best.append((-sum(q[k] * v.get(k, 0) for k in q), lang))
        assert r.lang_pred == min(best)[1] and abs(r.score + min(best)[0]) < 1e-4
    assert got[3] != got[4] and got[3].score == got[4].score
    same = spark.createDataFrame([(1, "xyz", "q2"), (2, "xyz", "q1")], "doc_id long, text string, lang string")  # a tie
    assert language_id.predict_language(same, language_id.learn_languages(same)).first().lang_pred == "q1"


def test_no_language_is_left_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    code = lambda i: letters[i % 26] + letters[i // 26 % 26] + letters[i // 676]
    docs = spark.createDataFrame([(i, f"{code(i)}{code(i)[::-1]} {code(i) * 2}", f"l{i:04d}") for i in range(1001)], "doc_id long, text string, lang string")
    model = language_id.learn_languages(docs)
    assert len(model.languages) == 1001
    got = language_id.predict_language(docs, model).join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 990


# --- Mixing --------------------------------------------------------------------------------------------------


def test_mixing_keeps_budgets(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "big" if i < 400 else None if i < 440 else "small", 1, 0.0) for i in range(460)]
    rows += [(900, None, "en", "empty", 1, 0.0), (901, "", "en", "empty", 1, 0.0), (None, "w", "en", "small", 1, 0.0)]
    docs = frame(spark, rows, DOCS).withColumn("mix_pass", F.lit("clash"))
    out = mixing.mix_sources(docs, max_passes=2.0)
    assert out.columns == [c for c in docs.columns if c != "mix_pass"] + ["mix_pass", "mix_block", "mix_key"]
    got = out.select("doc_id", "source", "mix_pass", "mix_key", F.size(F.expr("regexp_extract_all(coalesce(text, ''), 'w', 0)")).alias("n")).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.source, []).append(r)
    sizes = {s: sum(t.count("w") for _, t, _, x, *_ in rows if x == s and t) for s in tokens}
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert all(r.mix_pass == 1 for r in tokens["big"]) and sum(r.n for r in tokens["big"]) == sizes["big"]
    assert sum(r.n for r in tokens["small"]) == 2 * sizes["small"]
    assert sizes[None] <= sum(r.n for r in tokens[None]) <= 2 * sizes[None]
    assert len(tokens["empty"]) == 2
    assert mixing.mix_sources(docs.where("false"), max_passes=2.0).count() == 0


def test_mixing_permutes_blocks_and_keeps_repeated_rows_together(spark):
    rows = [(i, "w w", "small", 0) for i in range(300)] + [(1000 + i, "w w", "big", 0) for i in range(3000)] + [(7, "w w", "small", 1)] * 2
    out = mixing.mix_sources(frame(spark, rows, "doc_id long, text string, source string, copy int"), max_passes=1.7)
    got = mixing.in_mixed_order(out).select("doc_id", "source", "mix_pass", "mix_block", "mix_key", F.spark_partition_id().alias("p")).collect()
    small = {n: [r for r in got if r.source == "small" and r.mix_pass == n] for n in (1, 2)}
    assert len(small[1]) == 302 and 0.65 * 302 <= len(small[2]) <= 0.7 * 302
    assert sum(r.doc_id == 7 for r in small[1]) == 3 and sum(r.doc_id == 7 for r in small[2]) in (0, 3)
    assert [(r.mix_pass, r.mix_key) for r in got] == sorted((r.mix_pass, r.mix_key) for r in got)  # over all sources and tasks
    blocks = {r.doc_id: r.mix_block for r in small[1]}
    assert all(blocks[r.doc_id] == r.mix_block for r in small[2])
    runs = [[k for k, _ in itertools.groupby(r.mix_block for r in rows)] for rows in small.values()]
    assert all(len(set(x)) == len(x) for x in runs)  # a block lies together in each pass
    both = [b for b in runs[0] if b in runs[1]]
    assert both != [b for b in runs[1] if b in runs[0]]  # and in another place


def test_entropy_target_is_met(spark):
    sizes = frame(spark, [("a", 900), ("b", 90), ("c", 10), ("d", 0)], "source string, tokens long")
    import math

    plan = {r.source: r for r in mixing.source_plan(sizes, entropy=0.9, budget=10_000).collect()}
    w = [plan[s].weight for s in "abc"]
    assert abs(-sum(x * math.log(x) for x in w) - 0.9) < 1e-9 and abs(sum(w) - 1) < 1e-9
    assert plan["d"].weight == 0 and abs(sum(p.budget for p in plan.values()) - 10_000) <= 2


# --- Line dedup ----------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    lines = {i: line_dedup.lines_of(t) for i, t in rows if t is not None}
    plain = {i: [x.strip(" \t\n\r") for x in v] for i, v in lines.items()}
    words = {i: [len(line_dedup._WORD.findall(x)) for x in v] for i, v in lines.items()}
    seen, gone = {}, {i: set() for i in lines}
    runs = sorted((i, s, e) for i, v in plain.items() for s in range(len(v)) for e in range(s + 1, len(v) + 1) if sum(words[i][s:e]) >= least)
    for i, s, e in runs:
        first = seen.setdefault(tuple(plain[i][s:e]), (i, s))
        if first < (i, s):
            gone[i].update(range(s, e))
    return {i: "".join(x for k, x in enumerate(v) if k not in gone[i]) for i, v in lines.items()}


def test_line_dedup_equals_brute_force(spark):
    a, b, c = "one two three four.", "five six seven!", "eight nine ten eleven twelve."
    rows = [(1, f"{a} {b} {c}\nend of one."), (2, f"start here. {a} {b} {c}"), (3, f"{b} {c} {a}"), (4, f"{c}\n\n{a} {b}"), (5, None), (6, ""), (7, "\n\n"), (8, f"{a} {b} {a} {b} {a} {b}"), (9, "hi. " * 40), (10, "no end"), (11, f"{a} {b} {c}\nend of one.")]
    want = brute_lines(rows, 7)
    docs = frame(spark, [(i, t, "en", "s", i, 0.1) for i, t in rows], DOCS)
    out = line_dedup.dedup_lines(docs, least_words=7)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(5) is None and got == want
    digest = {r.doc_id: (r.n_removed, r.text_sha256) for r in line_dedup.line_dedup_digest(docs, least_words=7).collect()}
    assert all(digest[i][1] == hashlib.sha256(t.encode()).hexdigest() for i, t in want.items())
    assert digest[11][0] > 0 and digest[1][0] == 0


def test_line_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    t = "one two three four five six seven eight. nine ten eleven."
    rows = frame(spark, [(1, t), (1, t), (None, t), (2, t + " more.")])
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(rows, least_words=5).collect())
    assert got == [(0, t), (1, t), (1, t), (2, "more.")]
    assert line_dedup.dedup_lines(rows.where("false"), least_words=5).count() == 0
