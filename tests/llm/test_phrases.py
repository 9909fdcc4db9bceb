"""Phrase mining against a count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import phrases


def brute(rows, least, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    out = {}
    for (lang, words), a in found.items():
        holds = any(
            y_lang == lang and len(y) > len(words) and n >= a and any(y[i : i + len(words)] == words for i in range(len(y) - len(words) + 1))
            for (y_lang, y), n in found.items()
        )
        if not holds:
            cuts = [(1000 * a * total[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, rows in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1)
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "of", "É", "ß", "$1", "a-b", " x", " "]
    fixed = ["new york city council said", "strong tea", "one two three four five six seven", "the the the the the the"]
    out = []
    for i in range(500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(3):
            words.insert(rng.randint(0, len(words)), rng.choice(fixed))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    out += [(900, None, "en"), (901, "", "de"), (902, " .\n!", None), (903, "said so " * 40_000, "fr"), (903, "strong tea", "en"), (None, "Strong\ttea", "en"), (None, "strong tea", "en"), (904, "only", "xx")]
    return out


@pytest.mark.parametrize(("least", "sample", "top"), [(20, 1 / 8, 2000), (20, 0.0, 7), (3, 1 / 50, 2000), (100, 1.0, 2000)])
def test_collocations(spark, rows, least, sample, top):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "words": F.lit("w"), "key": F.lit(2), "phrase": F.lit("p")}).repartition(3)
    found = phrases.collocations(docs, least, top, sample).collect()
    assert {tuple(r) for r in found} == brute(rows, least, top) and len(found) == len({tuple(r) for r in found})


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_border_failures_bring_further_passes(spark, monkeypatch):
    """Without proposals each pass reaches one word further, and still every frequent phrase is found."""
    passes = []
    candidates = phrases._candidates
    monkeypatch.setattr(phrases, "_candidates", lambda sent: passes.append(1) or candidates(sent))
    docs = spark.createDataFrame([(i, "alpha beta gamma delta epsilon zeta", "en") for i in range(30)], "doc_id long, text string, lang string")
    found, totals = phrases.count_phrases(docs, 25, 0.0)
    assert len(passes) == 5
    assert {(r.words, r.n) for r in found.collect()} == {(k, 30) for k in range(1, 6)} and totals.first().n == 180
    assert found.count() == 6 + 5 + 4 + 3 + 2
    passes.clear()
    assert phrases.count_phrases(docs, 25, 1.0)[0].count() == 20 and len(passes) == 1


def test_phrases_with_one_key_are_told_apart():
    words = phrases.Words("en", [b"a b. c d. a b"])
    words.keys[1][:] = 7
    at = np.flatnonzero(words.valid[1])
    assert sorted((words.phrase(i, 2), n) for i, n in words.times(at, 2)) == [(b"a b", 2), (b"c d", 1)]


def test_filter_leaves_nothing_out(spark):
    keys = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys[:2500]], "key long")
    bits = phrases._set_bits(df, np.zeros(1 << 13, np.uint8))
    held = phrases.Filter(bits)
    assert held.holds(keys[:2500]).all() and held.holds(keys[2500:]).mean() < 0.2
    grown = phrases._set_bits(spark.createDataFrame([(int(k),) for k in keys[2500:]], "key long"), bits)
    assert phrases.Filter(grown).holds(keys).all() and np.array_equal(grown & bits, bits)


def test_phrases_of_one_key_are_marked():
    keys, marks = np.array([5, 9, 5, 5], np.uint64), np.array([3 << 12 | 7, 1 << 12 | 2, 4 << 12 | 1, 3 << 12 | 6], np.uint64)
    (batch,) = phrases._marked([(keys[:2], marks[:2]), (keys[:0], marks[:0]), (keys[2:], marks[2:])])
    assert sorted(zip(*batch.to_pydict().values())) == [(5, 0, 4 << 12 | 1), (5, 3, 3 << 12 | 6), (9, 1, 1 << 12 | 2)]


@pytest.mark.parametrize("copies", [False, True])
def test_rows_of_the_last_pass_do_not_grow_with_tasks(spark, monkeypatch, copies):
    sizes, whole = [], phrases.stage

    def counted(df, name):
        out = whole(df, name)
        if name == "spelled":
            sizes.append(out.filter("words > 0").count())
        return out

    monkeypatch.setattr(phrases, "stage", counted)
    texts = [" ".join(f"w{(i * (0 if copies else 7) + j) % 40}" for j in range(80)) for i in range(640)]
    docs = spark.createDataFrame([(i, text, "en") for i, text in enumerate(texts)], "doc_id long, text string, lang string")
    for tasks in (1, 32):
        found, totals = phrases.count_phrases(docs.repartition(tasks), 100)
        assert totals.first().n == 640 * 80 and found.count() == 200 and len(set(found.collect())) == 200
    assert sizes[1] < 1.5 * sizes[0]
