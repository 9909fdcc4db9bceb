"""Copies of one text that are too far apart from it, and from one another, to be linked."""

import random
from collections import Counter

from storelens.llm import minhash


def far_copies(n=160, places=40, edits=14, ways=60):
    """Copies with 14 edits, each at one of 40 places in one of 60 ways; each 40th has all but one of the edits of that before it."""
    rng = random.Random(5)
    chosen = []
    for i in range(n):
        picked = {x: rng.randrange(ways) for x in rng.sample(range(places), edits)}
        chosen.append(dict(list(chosen[-1].items())[1:]) if i % 40 == 39 else picked)
    base = [f"w{i}" for i in range(7 * places + 10)]
    return [" ".join(f"e{picked[i // 7]}" if i % 7 == 5 and i // 7 in picked else w for i, w in enumerate(base)) for picked in chosen] + [" ".join(base)]


def similar(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def test_far_copies_are_not_held_against_all_near_ones(spark, monkeypatch):
    monkeypatch.setattr(minhash, "stage", lambda df, name: df.localCheckpoint())
    base = [f"w{i}" for i in range(150)]
    edited = lambda places, name, of=base: [f"{name}x{i}" if i in places else w for i, w in enumerate(of)]
    near, far = 60, 40
    # Copies with one edit; one with three and another last word; one with three edits that the last text has as well, beside two of its own.
    close = edited({50, 60, 70}, "c")
    texts = [base] + [edited({i + 20}, f"n{i}") for i in range(near)] + [[*edited({30, 40, 90}, "m")[:-1], "end"], close]
    # That last word makes the component as a whole hold one shingle more of each far copy than any one member does.
    texts += [[*edited({10 + i % 5, 40 + i % 7, 70, 100}, f"f{i}")[:-1], "end"] for i in range(far)] + [edited({100, 110}, "l", close)]
    sets = [set(minhash.shingle_set(" ".join(t).encode()).view("int64").tolist()) for t in texts]
    times = Counter(x for s in sets for x in s)
    last, members = len(texts) - 1, range(near + 3)
    assert [i for i in range(near + 3, last + 1) if any(similar(sets[i], sets[j]) for j in members)] == [last]
    assert similar(sets[last], sets[near + 2]) and not similar(sets[last], sets[0])

    with_sets = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, shingles array<long>")
    posts = spark.createDataFrame([(1, i, len(s), 100 - i) for i, s in enumerate(sets)], "value long, node long, n long, weight long")
    heads = spark.createDataFrame([(1, 0, len(sets[0]))], "value long, b long, m long")
    alone = spark.createDataFrame([(i, n) for i, s in enumerate(sets) if (n := sum(times[x] == 1 for x in s))], "node long, own long")
    labels = spark.createDataFrame([(i, 0) for i in members], "node long, component long")
    pairs = {tuple(sorted(r)) for r in minhash._across(posts, heads, alone, labels, with_sets).collect()}
    assert (near + 2, last) in pairs
    # Before, each far copy met each copy with one edit.
    assert len(pairs) < near * far // 10


def test_far_copies_are_not_paired_with_each_other(spark, monkeypatch):
    texts = far_copies()
    sizes, whole = {}, minhash.stage

    def counted(df, name):
        out = whole(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "stage", counted)
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    want = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want)) and len(set(want)) == len(texts) - 4
    # Before, pairs of single copies were met list by list: 149,398 rows here.
    assert sizes["met"][1] < 100 * len(texts)
