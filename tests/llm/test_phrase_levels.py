"""Phrases of texts so many that a share of the support is one occurrence."""

import numpy as np
import pytest

from tidemark.llm import phrases


@pytest.mark.parametrize("most_words", [300_000, 0])
def test_only_phrases_of_frequent_phrases_are_counted(spark, monkeypatch, most_words):
    """Frequent words in pairs that are rare: nothing longer than a pair is counted, and few counts leave the tasks."""
    monkeypatch.setattr(phrases, "MOST_WORDS", most_words)
    monkeypatch.setattr(phrases, "ROW_WORDS", 50)
    rng, sizes, stored = np.random.default_rng(3), {}, phrases.stored
    docs = [(" ".join(f"w{i}" for i in rng.integers(0, 200, 40)) + ". one two three four five six", "en" if n % 3 else "de") for n in range(300)]

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(phrases, "stored", counted)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(8)
    words, found = phrases.phrase_counts(df, support=20, block_words=100)
    want = {("de", 100), ("en", 200)}
    names = ["one", "two", "three", "four", "five", "six"]
    assert {(r.lang, r.phrase, r.n) for r in found.collect()} == {(lang, " ".join(names[i : i + k]), n) for lang, n in want for k in range(2, 6) for i in range(7 - k)}
    assert words.count() == len([1 for lang in ("en", "de") for i in range(200) if sum(t.split(".")[0].split().count(f"w{i}") for t, x in docs if x == lang) >= 20]) + 12
    assert [sizes[f"phrase-level{k}"] for k in range(2, 6)] == [10, 8, 6, 4]
