"""Hashed maximum-entropy language model with a class-factored softmax over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import MULTIPLIER, SPACES, is_fold, mix, odd_numbers, small_batches, utf8, word_hashes
from storelens.session import stage

#: Words that are classes of their own, the classes of all other words, and the class of a text's end.
OWN_CLASSES, TAIL_CLASSES = 64, 31
CLASSES = OWN_CLASSES + 1 + TAIL_CLASSES
END = OWN_CLASSES
#: Feature buckets: a previous class, the class before it, and the hashed pair of both.
BUCKETS = 2048
FEATURES = 3
#: Most frequent words whose counts every worker knows; all other words' counts are joined.
FREQUENT = 50_000
ROUNDS, PARTITIONS = 12, 4
END_HASH = 0
#: A word of a tail class is one of GROUPS x SLOTS cells of its class. A class's most frequent words have a cell each; all
#: other words, known or not, share the cells of the last groups by their hash.
GROUPS, SLOTS, SHARED_GROUPS = 32, 32, 4
CELLS, SHARED = GROUPS * SLOTS, SHARED_GROUPS * SLOTS
#: Hashed rows of weights of the three softmaxes: over classes, over a class's groups, over a group's cells.
ROWS, WIDTHS = (1 << 14, 1 << 16, 1 << 16), (CLASSES, GROUPS, SLOTS)
#: Tokens of a step, tokens that one task learns from (more with larger input files), size of the steps.
STEP, SHARD, RATE = 4096, 4_000_000, 0.5
#: Tokens of a row that are added for all rows at a time.
AT_ONCE = 8
HELD = "factor int, row int, n long, step binary"
_SALTS = odd_numbers(7, 0xA24BAED4963EE407)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and for each the class its last two bytes give."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes.view(np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower(), np.uint8)
    space = _SPACE[codes]
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    before = np.where(ends > 0, codes[ends - 1], 32).astype(np.uint64)
    before[_SPACE[before.astype(np.int64)]] = 32
    tail = mix(before * np.uint64(256) + codes[ends]) % np.uint64(TAIL_CLASSES)
    return hashes.view(np.int64), tail.astype(np.int64) + OWN_CLASSES + 1


def _counted(batches):
    """Rows (word, tail, n) per batch, with the ends of texts as a word."""
    for batch in batches:
        found = [tokens(text or b"") for text in utf8(batch.column(0))]
        words = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.int64)
        tails = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int64)
        unique, first, n = np.unique(words, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(unique, END_HASH)), pa.array(np.append(tails[first], END)), pa.array(np.append(n, len(found)).astype(np.int64))],
            ["word", "tail", "n"],
        )


@dataclass
class Lexicon:
    """What every worker knows: the frequent words, sorted by hash, with their counts, classes (-1: by their tail) and cells (-1: shared)."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    cells: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for words that aren't frequent."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def classify(self, places: np.ndarray, tails: np.ndarray) -> np.ndarray:
        own = np.append(self.classes, -1)[places]
        return np.where(own >= 0, own, tails)

    def cell(self, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Cells of words in their class, the shared ones by hash."""
        own = np.append(self.cells, -1)[places]
        return np.where(own >= 0, own, CELLS - SHARED + (hashes & (SHARED - 1)))


def contexts(classes: np.ndarray) -> np.ndarray:
    """Codes (class before, previous class) of each token and of the end; the end's class also stands before a text."""
    padded = np.concatenate(([END, END], classes))
    return padded[:-1] * CLASSES + padded[1:]


def buckets_of(codes: np.ndarray) -> np.ndarray:
    """The three feature buckets of each context: previous class, skipped one, hashed pair."""
    pair = mix(codes.astype(np.uint64) + np.uint64(MULTIPLIER)) % np.uint64(BUCKETS - 2 * CLASSES)
    return np.stack([codes % CLASSES, CLASSES + codes // CLASSES, 2 * CLASSES + pair.astype(np.int64)], axis=1)


def log_softmax(weights: np.ndarray, bias: np.ndarray, codes: np.ndarray) -> np.ndarray:
    logits = weights[buckets_of(codes)].sum(axis=1) + bias
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _transitions(sent):
    def run(batches):
        lexicon = Lexicon(*sent.value)
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                hashes, tails = tokens(text or b"")
                classes = lexicon.classify(lexicon.find(hashes), tails)
                codes = contexts(classes) * CLASSES + np.append(classes, END)
                if len(codes) > len(total) // 64:
                    total += np.bincount(codes, minlength=len(total))
                else:
                    np.add.at(total, codes, 1)
        at = np.flatnonzero(total)
        for start in range(0, len(at), 100_000):
            part = at[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part // CLASSES), pa.array((part % CLASSES).astype(np.int32)), pa.array(total[part])], ["context", "class", "n"])

    return run


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of a batch and their counts by class."""
    codes = np.array(batch.column(0).to_numpy(), np.int64)
    counts = np.zeros((len(codes), CLASSES))
    for i, (classes, n) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
        counts[i, np.asarray(classes.values)] = np.asarray(n.values)
    return codes, counts


def _gradient(sent):
    """Observed and expected counts per touched bucket and class over a partition's contexts."""

    def run(batches):
        weights, bias = sent.value
        observed, expected, touched = np.zeros((BUCKETS, CLASSES)), np.zeros((BUCKETS, CLASSES)), np.zeros(BUCKETS, bool)
        for batch in batches:
            codes, counts = _rows_of(batch)
            chance = np.exp(log_softmax(weights, bias, codes)) * counts.sum(axis=1, keepdims=True)
            for held in buckets_of(codes).T:
                np.add.at(observed, held, counts)
                np.add.at(expected, held, chance)
                touched[held] = True
        at = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array([x.tobytes() for x in observed[at]], pa.binary()), pa.array([x.tobytes() for x in expected[at]], pa.binary())],
            ["bucket", "observed", "expected"],
        )

    return run


def train(moves: DataFrame, class_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (context, classes, counts) rows.

    Each round is a Spark job: tasks sum the observed and expected counts of their contexts per feature,
    the driver adds up the partitions' sums, of a size that the model fixes, and steps along their
    difference, the gradient of the log-likelihood, by each coordinate's own step size.
    """
    context = moves.sparkSession.sparkContext
    bias = np.log((class_counts + 1.0) / (class_counts + 1.0).sum())
    weights = np.zeros((BUCKETS, CLASSES))
    for _ in range(ROUNDS):
        sent = context.broadcast((weights, bias))
        observed, expected = np.zeros((BUCKETS, CLASSES)), np.zeros((BUCKETS, CLASSES))
        for row in moves.mapInArrow(_gradient(sent), "bucket long, observed binary, expected binary").toLocalIterator():
            observed[row.bucket] += np.frombuffer(row.observed)
            expected[row.bucket] += np.frombuffer(row.expected)
        weights = weights + 1.5 / FEATURES * (observed - expected) / (np.maximum(observed, expected) + 1.0)
        sent.unpersist()
    return weights, bias


def history(hashes: np.ndarray) -> np.ndarray:
    """The three word features of each token and of the end: previous word, the one before it, hashed pair of both."""
    padded = np.concatenate((np.full(2, END_HASH, np.int64), hashes)).view(np.uint64)
    before, skipped = padded[1:], padded[:-1]
    pair = mix(before * _SALTS[2] + mix(skipped + _SALTS[3]))
    return np.stack([mix(before + _SALTS[0]), mix(skipped + _SALTS[1]), pair], axis=1)


def rows_of(features: np.ndarray, factor: int, parts: np.ndarray) -> np.ndarray:
    """Hashed rows of weights for the features of tokens in a softmax; ``parts`` tells which class or group it is over."""
    keys = (parts.astype(np.uint64) + np.uint64(1)) * _SALTS[4 + factor]
    return (mix(features + keys[:, None]) % np.uint64(ROWS[factor])).astype(np.int64)


@dataclass
class Softmax:
    """One factor: log-odds ``base[part]`` that are given, and a hashed row of weights for each feature."""

    base: np.ndarray
    weights: np.ndarray

    def chances(self, parts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = self.base.take(parts, axis=0)
        for held in rows.T:
            out += self.weights.take(held, axis=0)
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out *= (1 / (out @ np.ones(out.shape[1], np.float32)))[:, None]
        return out

    def logs(self, parts: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Natural logarithm of what each token's choice has."""
        out = np.zeros(len(chosen))
        for at in range(0, len(chosen), STEP):
            here = slice(at, at + STEP)
            chance = self.chances(parts[here], rows[here])
            out[here] = np.log(np.maximum(chance[np.arange(len(chance)), chosen[here]], 1e-30))
        return out

    def learn(self, parts: np.ndarray, rows: np.ndarray, chosen: np.ndarray, squares: np.ndarray) -> None:
        """One step along the gradient, observed minus expected choices, with a step size per row."""
        slope = self.chances(parts, rows)
        np.negative(slope, out=slope)
        slope[np.arange(len(slope)), chosen] += 1
        held, total = sums(slope, rows)
        squares[held] += np.einsum("ij,ij->i", total, total)
        total *= (RATE / np.sqrt(squares[held] + 1))[:, None]
        total += self.weights.take(held, axis=0)
        self.weights[held] = total


def sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights that tokens have, and for each the sum of these tokens' values.

    Few rows have many tokens: the first tokens of all rows are added at a time, the others row by row.
    """
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16) if max(ROWS) <= 1 << 16 else flat, kind="stable")
    held = flat[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    n = np.diff(np.append(starts, len(held)))
    by_size = np.argsort(-n, kind="stable")
    starts, n = starts[by_size], n[by_size]
    sorted_values = values.take(order // rows.shape[1], axis=0)
    total = sorted_values.take(starts, axis=0)
    for j in range(1, min(n[0], AT_ONCE)):
        more = np.searchsorted(-n, -j)
        total[:more] += sorted_values.take(starts[:more] + j, axis=0)
    for i in range(np.searchsorted(-n, -AT_ONCE)):
        rest = sorted_values[starts[i] + AT_ONCE : starts[i] + n[i]]
        total[i] += np.ones(len(rest), np.float32) @ rest
    return held[starts], total


def factors(lexicon: Lexicon, texts: list[bytes | None]):
    """The choices that give the tokens of texts: for each of three softmaxes (tokens, parts, rows, chosen), with the texts' starts, words and places."""
    read = [tokens(text or b"") for text in texts]
    starts = np.cumsum([0] + [len(h) + 1 for h, _ in read])
    hashes, tails = (np.concatenate([np.append(r[i], end) for r in read]) for i, end in ((0, END_HASH), (1, END)))
    places = lexicon.find(hashes)
    ends = np.zeros(len(hashes), bool)
    ends[starts[1:] - 1] = True
    places[ends] = -1
    classes = lexicon.classify(places, tails)
    features = np.concatenate([history(h) for h, _ in read])
    codes = np.concatenate([contexts(classes[a : b - 1]) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    inner = np.flatnonzero(classes > END)
    part, cells, within = classes[inner] - END - 1, lexicon.cell(places[inner], hashes[inner]), features[inner]
    groups = part * GROUPS + cells // SLOTS
    return starts, hashes, places, ends, (
        (np.arange(len(hashes)), codes, rows_of(features, 0, np.zeros(len(hashes))), classes),
        (inner, part, rows_of(within, 1, part), cells // SLOTS),
        (inner, groups, rows_of(within, 2, groups), cells % SLOTS),
    )


def _fitted(sent):
    """What a pass over the task's texts adds to each row of weights, and how many tokens had the row."""

    def run(batches):
        lexicon, bases = Lexicon(*sent.value[:4]), sent.value[4]
        model = [Softmax(base, np.zeros((n, width), np.float32)) for base, n, width in zip(bases, ROWS, WIDTHS, strict=True)]
        squares, seen = [np.zeros(n, np.float32) for n in ROWS], [np.zeros(n, np.int64) for n in ROWS]
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, (_, parts, rows, chosen) in enumerate(factors(lexicon, list(utf8(batch.column(0))))[-1]):
                seen[i] += np.bincount(rows.ravel(), minlength=ROWS[i])
                # Steps have tokens of all the batch's texts, so that no long or odd text is learned last.
                mixed = np.random.default_rng(len(chosen)).permutation(len(chosen))
                for at in range(0, len(chosen), STEP):
                    here = mixed[at : at + STEP]
                    model[i].learn(parts[here], rows[here], chosen[here], squares[i])
        for i, factor in enumerate(model):
            yield from _packed(i, seen[i], factor.weights)

    return run


def _packed(factor: int, seen: np.ndarray, steps: np.ndarray):
    touched = np.flatnonzero(seen)
    for start in range(0, len(touched), 4096):
        at = touched[start : start + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), factor, np.int32)), pa.array(at.astype(np.int32)), pa.array(seen[at]),
             pa.array([x.tobytes() for x in steps[at].astype(np.float32)], pa.binary())],
            ["factor", "row", "n", "step"],
        )


def _mixed(batches):
    """Rows of weights over all tasks: the mean of their steps by how many tokens had the row."""
    total, seen = [np.zeros((n, width)) for n, width in zip(ROWS, WIDTHS, strict=True)], [np.zeros(n, np.int64) for n in ROWS]
    for batch in batches:
        kinds, rows, counts = (np.asarray(batch.column(i)) for i in range(3))
        for i in range(len(ROWS)):
            at = np.flatnonzero(kinds == i)
            if len(at):
                steps = np.frombuffer(b"".join(batch.column(3).take(pa.array(at)).to_pylist()), np.float32).reshape(len(at), -1)
                np.add.at(total[i], rows[at], steps * counts[at, None].astype(float))
                np.add.at(seen[i], rows[at], counts[at])
    for i in range(len(ROWS)):
        yield from _packed(i, seen[i], total[i] / np.maximum(seen[i], 1)[:, None])


def fit(training: DataFrame, sent, tasks: int) -> list[np.ndarray]:
    """Weights of the three softmaxes from texts.

    Each task goes over its texts once in small steps; what tasks have learned of a row is averaged by Spark, weighted by
    the tokens that had it. The driver and every task hold tables of a size that the model fixes.
    """
    weights = [np.zeros((n, width), np.float32) for n, width in zip(ROWS, WIDTHS, strict=True)]
    held = training.coalesce(tasks).mapInArrow(_fitted(sent), HELD).repartition(PARTITIONS, "row").mapInArrow(_mixed, HELD)
    for row in held.toLocalIterator():
        weights[row.factor][row.row] = np.frombuffer(row.step, np.float32)
    return weights


def _scored(sent):
    """Per text what its frequent words and its classes give, and the words whose counts must be joined."""

    def run(batches):
        lexicon, bases, weights, sizes = Lexicon(*sent.value[:4]), *sent.value[4:]
        model = [Softmax(base, held) for base, held in zip(bases, weights, strict=True)]
        logs = np.log10(lexicon.counts + 1.0)
        # What frequent words that share a cell have of it; the others' counts are joined.
        shared = np.append(np.where((lexicon.cells < 0) & (lexicon.classes < 0), logs, 0.0), 0.0)
        for batch in batches:
            out = []
            if batch.num_rows:
                starts, hashes, places, ends, choices = factors(lexicon, list(utf8(batch.column(1))))
                score = shared[places]
                for factor, (at, parts, rows, chosen) in zip(model, choices, strict=True):
                    score[at] += factor.logs(parts, rows, chosen) / np.log(10)
                at, groups, _, slots = choices[2]
                score[at] -= sizes[groups, slots]
                score = np.add.reduceat(score, starts[:-1])
            for i in range(batch.num_rows):
                here = slice(starts[i], starts[i + 1] - 1)
                found = places[here]
                known = found[found >= 0]
                rest, times = np.unique(hashes[here][found < 0], return_counts=True)
                out.append((len(found) + 1, len(known), float(logs[known].sum()) if len(known) else 0.0, float(score[i]), rest, times.astype(np.int64)))
            n, known, base, score, rest, times = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                 pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "known", "logs", "score", "words", "times"],
            )

    return run


def layout(vocabulary: DataFrame, listed: list, ends: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Cells of the listed words, counts of classes, log shares of groups and of cells, and what a word's count is divided by.

    A cell of its own weighs its word's c + 1. A shared one weighs the sum of c + 1 over its words, and its part of the class's one
    share for unknown words; ``sizes`` is the log10 of that, and nothing for a cell of one word, which has all of it.
    """
    cells, class_counts = np.full(len(listed), -1), np.zeros(CLASSES)
    mass = np.zeros((CLASSES - END - 1, CELLS))
    mass[:, CELLS - SHARED :] = 1 / SHARED
    shared = vocabulary.filter(F.col("word") != END_HASH).groupBy("tail", F.col("word").bitwiseAND(F.lit(SHARED - 1)).alias("cell"))
    for r in shared.agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r.tail - END - 1, CELLS - SHARED + r.cell] += r.c + r.v
        class_counts[r.tail] += r.c
    class_counts[END] = ends
    taken = np.zeros(len(mass), int)
    for i, r in enumerate(listed):
        tail, cell = r.tail - END - 1, CELLS - SHARED + (r.word & (SHARED - 1))
        if i < OWN_CLASSES:
            class_counts[i] = r.c
        elif taken[tail] < CELLS - SHARED:
            cells[i] = taken[tail]
            mass[tail, cells[i]] = r.c + 1
            taken[tail] += 1
        else:
            continue
        mass[tail, cell] -= r.c + 1
        class_counts[r.tail] -= r.c if i < OWN_CLASSES else 0
    groups = mass.reshape(len(mass), GROUPS, SLOTS)
    sizes = np.zeros(groups.shape)
    sizes[:, GROUPS - SHARED_GROUPS :] = np.log10(groups[:, GROUPS - SHARED_GROUPS :])
    bases = [np.log(np.maximum(m, 1e-30)).astype(np.float32) for m in (groups.sum(axis=2), groups.reshape(-1, SLOTS))]
    return cells, class_counts, bases, sizes.reshape(-1, SLOTS)


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) mod 7 is not 2.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end per text. base_score is the sum of
    log10((c + 1) / (N + V + 1)) over the training counts. score is the log10 probability of the model:
    P(class | words before) * P(word | class, words before). The most frequent words and the end are classes
    of their own, other words have a class by their last two bytes.

    Both factors are softmaxes over hashed features of the previous word, the one before it, and both, for
    any words. Their log-odds start from what a model without words gives: the first from a softmax over
    weights of the previous class, the one before it, and the hashed pair, the second from shares of the
    class, (c + 1) / (N_class + V_class + 1), with one left for unknown words. The second goes by groups of
    a class and cells of a group. A class's most frequent words have a cell each; all others share cells by
    hash, with the odds of the cell, and a word's share of it is by count. A feature's weights for all
    choices of a softmax are a row of a table of fixed size, chosen by hash.

    All counts and weights are of all training documents, each token being learned from once. The order in
    which that happens and the tasks' means follow the layout of the input's files, so score (no other
    column) differs a little between layouts. Words are told apart by 64-bit hashes. Counts of the most
    frequent words, a list of fixed length, are broadcast; all others are joined, and as no such word
    is frequent, no join key is hot. Class transitions are summed per task before they are shuffled.

    Null and empty texts have the end as their only token. A null doc_id is in the training part. Rows
    that repeat are counted and scored each. Without training rows all counts are 0. Other columns are ignored.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    training = docs.filter(~is_fold("doc_id", 7, 2)).select("text")
    counted = training.mapInArrow(_counted, "word long, tail long, n long")
    vocabulary = stage(counted.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("c")).filter("c > 0"), "vocabulary")
    size, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    listed = vocabulary.filter(F.col("word") != END_HASH).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    order = sorted(range(len(listed)), key=lambda i: listed[i].word)
    words = np.array([listed[i].word for i in order], np.int64)
    counts = np.array([listed[i].c for i in order], np.int64)
    own = np.array([i if i < OWN_CLASSES else -1 for i in order], np.int64)
    ends = sum(r.c for r in vocabulary.filter(F.col("word") == END_HASH).collect())
    cells, class_counts, bases, sizes = layout(vocabulary, listed, ends)
    cells = cells[order]

    sent = context.broadcast((words, counts, own, cells))
    moves = training.mapInArrow(_transitions(sent), "context long, class int, n long")
    moves = moves.groupBy("context", "class").agg(F.sum("n").alias("n")).groupBy("context").agg(
        F.collect_list(F.struct("class", "n")).alias("held")
    ).select("context", F.col("held.class").alias("classes"), F.col("held.n").alias("counts"))
    moves = stage(moves.repartition(PARTITIONS, "context"), "moves")
    weights, bias = train(moves, class_counts)
    bases = [log_softmax(weights, bias, np.arange(CLASSES**2)).astype(np.float32), *bases]
    sent.unpersist()

    sent = context.broadcast((words, counts, own, cells, bases))
    weights = fit(training, sent, max(1, -(-int(size) // SHARD)))
    sent.unpersist()

    sent = context.broadcast((words, counts, own, cells, bases, weights, sizes))
    kinds = "doc_id long, n_tokens long, known long, logs double, score double, words array<long>, times array<long>"
    scored = stage(docs.mapInArrow(_scored(sent), kinds).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.arrays_zip("words", "times").alias("rest")).select("row", F.explode("rest").alias("rest"))
    rest = rest.select("row", F.col("rest.words").alias("word"), F.col("rest.times").alias("times"))
    found = rest.join(vocabulary.select("word", "c"), "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs")
    )
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    unknown = F.col("n_tokens") - 1 - F.col("known") - more
    end = float(np.log10(ends + 1.0))
    return scored.drop("words", "times").join(found, "row", "left").select(
        "doc_id", is_fold("doc_id", 7, 2).alias("held_out"), "n_tokens", (F.col("known") + more + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(size)).cast("long").alias("train_tokens"),
        (F.col("logs") + logs + end - F.col("n_tokens") * float(np.log10(size + distinct + 1))).alias("base_score"),
        (F.col("score") + logs - unknown * float(np.log10(SHARED))).alias("score"),
    )


#: What of the result SQL can express: everything but the model's score.
BASE_SQL = """
WITH w AS (SELECT doc_id, coalesce(doc_id IS NOT NULL AND HELD, false) AS held_out, list_append(list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), '\\n') AS t FROM documents),
u AS (SELECT doc_id, held_out, unnest(t) AS k FROM w),
c AS (SELECT k, count(*) AS c FROM u WHERE NOT held_out GROUP BY k),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
  sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
FROM u LEFT JOIN c USING (k), s GROUP BY doc_id, held_out
"""
