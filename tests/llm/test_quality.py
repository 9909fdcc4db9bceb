"""Compression classifier: held-out accuracy and odd input."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from storelens.llm import quality


def test_quality(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 400))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + rng.choice(["$$$", "###", "!!"]) for w in words) if bad else " ".join(words)))
        labels.append((i, int(not bad)))
    rows += [(2000, None), (2001, ""), (None, "x"), (3, rows[3][1]), (3, "other text of the same id"), (2002, "### ".join(rng.choice(vocabulary) for _ in range(90_000))), (2003, " ".join(rng.choice(vocabulary) for _ in range(90_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit("l"), "score": F.lit(1), "part": F.lit(2), "key": F.lit(3)})
    given = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    found = quality.quality(docs, given).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in found}
    assert by[2002].predicted == 0 and by[2003].predicted == 1 and by[2000].score == by[2001].score
    assert quality.quality(docs.limit(0), given).count() == 0
    assert {tuple(r) for r in quality.quality(docs, given).collect()} == {tuple(r) for r in found}
    # Held-out labels change nothing.
    turned = given.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {tuple(r) for r in quality.quality(docs, turned).collect()} == {tuple(r) for r in found}


def test_quality_with_little_to_learn_from(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(12)], "doc_id long, text string")
    for labels in ([], [(0, 1), (1, 1)], [(0, 1), (1, 0), (3, 0), (4, 1)]):
        found = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(found) == 12 and all(0 <= r.score <= 1 for r in found)
    assert quality.quality(docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")).first().score == 0.75


def test_the_end_of_a_text_counts_as_much_as_its_start():
    rng = random.Random(2)
    good, bad = ([" ".join(rng.choice(v) for _ in range(150)).encode() for _ in range(60)] for v in (["tree", "house", "garden"], ["win###", "cash$$$", "now!!"]))
    model = quality.Model(quality.dictionary(good), quality.dictionary(bad), 1.0, 0.0)
    mixed = [b" ".join(good[:20]), b" ".join(bad[:20])]
    first, last = model.difference(b" ".join(mixed)), model.difference(b" ".join(mixed[::-1]))
    assert model.difference(good[0]) > 0 > model.difference(bad[0]) and abs(first - last) < 0.1 * model.difference(good[0])


def test_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(0.1, 0.05, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(40 * x - 3)))).astype(float)
    slope, base = quality.calibrated(x, y)
    assert abs(slope - 40) < 2 and abs(base + 3) < 0.3
    assert quality.calibrated(x, np.ones(20_000))[0] == 0.0 and quality.calibrated(x, 1 - y)[0] == 0.0
