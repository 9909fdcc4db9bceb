"""The word level of the maximum-entropy model: words before a word decide it, and all words of a class have one share in all."""

import random
import zlib

import numpy as np

from storelens.llm import maxent


def test_words_before_decide_among_words_of_a_class(spark):
    """Two words of one class and one count, told apart by nothing but the word before or the one before that."""
    rng = random.Random(5)
    filler = [f"w{i}" for i in range(80)]
    told = ["red first-ample", "blue other-ample", "far so third-ample", "near so fourth-ample"]
    rows = [(i, " ".join(x for _ in range(12) for x in (*rng.choices(filler, k=3), told[(i + rng.randrange(4)) % 4]))) for i in range(1500)]
    texts = {1: "red first-ample", 2: "red other-ample", 3: "far so third-ample", 4: "far so fourth-ample"}
    given = {k: next(i for i in range(10_000 * k, 10_000 * (k + 1)) if zlib.crc32(str(i).encode()) % 7 == 2) for k in texts}
    rows += [(given[k], text) for k, text in texts.items()]
    found = {r.doc_id: r for r in maxent.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].held_out and found[i].n_known == found[i].n_tokens for i in given.values())
    score = {k: found[i].score for k, i in given.items()}
    assert score[1] > score[2] + 0.5 and score[3] > score[4] + 0.5


def test_shares_of_a_class(spark):
    """What a class's words and an unknown word in each shared cell have of it is one in all."""
    tails = [maxent.END + 1 + i % 3 for i in range(4000)]
    words = [maxent.word_hashes(f"x{i}".encode()).view(np.int64)[0].item() for i in range(4000)]
    rows = [(w, t, 1 + 10_000 // (i + 1)) for i, (w, t) in enumerate(zip(words, tails))]
    vocabulary = spark.createDataFrame([*rows, (maxent.END_HASH, maxent.END, 77)], "word long, tail long, c long")
    listed = vocabulary.filter(f"word != {maxent.END_HASH}").orderBy("c", "word", ascending=[False, True]).limit(3500).collect()
    cells, class_counts, (groups, slots), sizes = maxent.layout(vocabulary, listed, 77)
    assert class_counts.sum() == 77 + sum(c for _, _, c in rows) and class_counts[maxent.END] == 77
    own = {r.word: cell for r, cell in zip(listed, cells)}
    # The 64 most frequent words are classes, the next of each class have a cell each, the others share.
    assert all(own[r.word] == -1 for r in listed[: maxent.OWN_CLASSES]) and max(cells) == maxent.CELLS - maxent.SHARED - 1
    assert any(cell == -1 for cell in cells[maxent.OWN_CLASSES :])
    singles = {r.word for r in listed[: maxent.OWN_CLASSES]}
    total = np.zeros(3)
    group_share = np.exp(groups[:3]) / np.exp(groups[:3]).sum(axis=1, keepdims=True)
    slot_share = (np.exp(slots) / np.exp(slots).sum(axis=1, keepdims=True)).reshape(len(groups), maxent.GROUPS, maxent.SLOTS)[:3]
    share = (group_share[:, :, None] * slot_share).reshape(3, -1)
    for w, t, c in rows:
        if w not in singles:
            tail, cell = t - maxent.END - 1, own.get(w, -1)
            inside = 1.0
            if cell < 0:
                cell = maxent.CELLS - maxent.SHARED + (w & (maxent.SHARED - 1))
                inside = (c + 1) / 10 ** sizes.reshape(len(groups), -1)[tail, cell]
            total[tail] += share[tail, cell] * inside
    rest = 10 ** -sizes.reshape(len(groups), -1)[:3, -maxent.SHARED :] / maxent.SHARED
    total += (share[:, -maxent.SHARED :] * rest).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)


def test_steps_against_a_dense_model():
    """Steps along hashed rows are those of a model that has a plain weight for each feature and choice."""
    rng = np.random.default_rng(1)
    base = np.log(rng.dirichlet(np.ones(7), size=4)).astype(np.float32)
    model, squares = maxent.Softmax(base, np.zeros((50, 7), np.float32)), np.zeros(50, np.float32)
    weights, past = np.zeros((50, 7)), np.zeros(50)
    for _ in range(5):
        parts, chosen = rng.integers(0, 4, 300), rng.integers(0, 7, 300)
        rows = np.minimum(rng.zipf(1.4, size=(300, 3)), 50) - 1
        slope = np.zeros((50, 7))
        for part, held, choice in zip(parts, rows, chosen):
            odds = np.exp(base[part] + weights[held].sum(axis=0))
            for row in held:
                slope[row] -= odds / odds.sum()
                slope[row, choice] += 1
        past += (slope**2).sum(axis=1)
        weights += slope * maxent.RATE / np.sqrt(past + 1)[:, None]
        model.learn(parts, rows, chosen, squares)
    assert np.allclose(model.weights, weights, atol=1e-3)
    parts, rows, chosen = np.array([2, 0]), np.array([[0, 1, 2], [3, 3, 9]]), np.array([1, 6])
    odds = np.exp(base[parts] + weights[rows].sum(axis=1))
    assert np.allclose(model.logs(parts, rows, chosen), np.log(odds[[0, 1], chosen] / odds.sum(axis=1)), atol=1e-3)


def test_tasks_are_averaged_by_their_tokens():
    parts = [(3, 2.0, [0, 5]), (1, 6.0, [5])]
    batches = []
    for n, step, rows in parts:
        seen = np.zeros(maxent.ROWS[1], np.int64)
        seen[rows] = n
        batches += maxent._packed(1, seen, np.full((maxent.ROWS[1], maxent.GROUPS), step))
    (mixed,) = maxent._mixed(batches)
    got = {row: (n, np.frombuffer(step, np.float32).tolist()) for _, row, n, step in (r.values() for r in mixed.to_pylist())}
    assert got == {0: (3, [2.0] * maxent.GROUPS), 5: (4, [3.0] * maxent.GROUPS)}
