"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import MULTIPLIER, arrays, is_fold, mix, odd_numbers, pieces, release, small_batches, utf8
from storelens.session import stage

BUCKETS = 1 << 20
#: Beginnings of longer words are terms, too: their first so many bytes, from the one number to the other.
SHORTEST, LONGEST = 4, 8
#: Labelled rows that the model is fitted on at most, chosen by a hash of the doc_id.
SAMPLE_ROWS = 12_000
#: Terms of the model: those with at least this likelihood ratio with the label in the fitting rows,
#: and those whose factors keep this share of the longest in a sparse machine over all terms in LEAST_ROWS rows.
LEAST_RATIO, LEAST_SHARE, LEAST_ROWS = 20.0, 0.2, 2
#: The sparse machine: epochs, or more where these are fewer steps; step sizes and shrinkage of weights and factors, first sums of squares, spread of first factors.
SPARSE_EPOCHS, SPARSE_STEPS, WEIGHT_RATE, FACTOR_RATE, WEIGHT_SHRINK, FACTOR_SHRINK, FIRST_SUM, SPREAD = 5, 300, 0.1, 0.05, 6e-3, 8e-3, 1e-4, 0.02
FACTORS, EPOCHS, BATCH_ROWS, RATE, DECAY = 8, 6, 128, 0.1, 1e-4
REJECT = 0.7

#: ASCII letters and digits and all bytes above stay, A-Z lower-cased; the rest separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_CODES = odd_numbers(256, MULTIPLIER)
_CODES[32] = 0
_STEPS = odd_numbers(64, 0x8EBC6AF09C88C6E3)


def terms(text: bytes) -> np.ndarray:
    """Hash buckets of a text's words and of the beginnings of longer words, with repeats."""
    out = []
    for part in pieces(text.translate(_TABLE)):
        codes = np.frombuffer(part, np.uint8)
        word = codes != 32
        if not word.any():
            continue
        starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
        ends = np.flatnonzero(word & np.concatenate((~word[1:], [True]))) + 1
        lengths = ends - starts
        values = _CODES[codes]
        # A word's hash: its letters, each weighted by its place in the word, in cycles of 64.
        of = np.maximum(np.cumsum(word & np.concatenate(([True], ~word[:-1]))) - 1, 0)
        weighted = values * _STEPS[(np.arange(len(codes)) - starts[of]) & 63]
        out.append(mix(np.add.reduceat(weighted, starts) + lengths.astype(np.uint64)))
        first, left, total = starts, lengths, np.zeros(len(starts), np.uint64)
        for size in range(1, LONGEST + 1):
            longer = left > size
            first, left, total = first[longer], left[longer], total[longer]
            if not len(first):
                break
            total = total + values[first + size - 1] * _STEPS[size - 1]
            if size >= SHORTEST:
                out.append(mix(total + np.uint64(1000 + size)))
    found = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64)


def repeated(buckets: np.ndarray) -> np.ndarray:
    """Buckets for terms that occur twice or more."""
    return (mix(buckets.astype(np.uint64) + np.uint64(BUCKETS)) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of their factors' products)."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        self.again = self.place[repeated(np.arange(BUCKETS))]

    def raw(self, held: np.ndarray) -> np.ndarray:
        sums = held @ self.factors
        pairs = 0.5 * (sums**2 - held @ self.factors**2).sum(axis=1)
        return self.bias + held @ self.weights + pairs

    def present(self, found: np.ndarray) -> np.ndarray:
        """Places of the model's terms among buckets with repeats."""
        at, again = self.place[found], self.again[found]
        again = np.bincount(again[again >= 0], minlength=1)
        return np.union1d(at[at >= 0], np.flatnonzero(again >= 2))

    def score(self, text: bytes) -> float:
        at = self.present(terms(text))
        factors = self.factors[at]
        pairs = 0.5 * (factors.sum(axis=0) ** 2 - (factors**2).sum(axis=0)).sum()
        return float(_sigmoid(self.bias + self.weights[at].sum() + pairs))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, seed: int = 7) -> Machine:
    """Stochastic gradient descent with Adagrad steps on the logistic loss. rows: places of each row's terms."""
    rng = np.random.default_rng(seed)
    positive = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(buckets, float(np.log(positive / (1 - positive))), np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), FACTORS)))
    if not len(buckets) or len(set(labels.tolist())) < 2:
        return machine
    sums = [1e-6, np.full(len(buckets), 1e-6), np.full((len(buckets), FACTORS), 1e-6)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH_ROWS):
            chosen = order[at : at + BATCH_ROWS]
            held = np.zeros((len(chosen), len(buckets)))
            for i, row in enumerate(chosen):
                held[i, rows[row]] = 1
            sums_of = held @ machine.factors
            error = (_sigmoid(machine.raw(held)) - labels[chosen]) / len(chosen)
            for k, step in enumerate((
                error.sum(),
                held.T @ error + DECAY * machine.weights,
                held.T @ (error[:, None] * sums_of) - (held.T @ error)[:, None] * machine.factors + DECAY * machine.factors,
            )):
                sums[k] = sums[k] + step**2
                change = RATE * step / np.sqrt(sums[k])
                if k == 0:
                    machine.bias -= float(change)
                elif k == 1:
                    machine.weights -= change
                else:
                    machine.factors -= change
    return machine


def paired(rows: list[np.ndarray], labels: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Places of the terms that matter in pairs, by a sparse machine over all ``size`` terms.

    Its Adagrad steps only touch the terms of a batch's rows. After each step a weight and a term's factors
    as a group are drawn to zero, so factors stay long only where pairs explain the label.
    """
    rng = np.random.default_rng(seed)
    positive = (labels.sum() + 1) / (len(labels) + 2)
    bias, bias_sum = float(np.log(positive / (1 - positive))), FIRST_SUM
    weights, factors = np.zeros(size), rng.normal(0, SPREAD, (size, FACTORS))
    weight_sums, factor_sums = np.full(size, FIRST_SUM), np.full((size, 1), FIRST_SUM)
    lengths = np.array([len(r) for r in rows], np.int64)
    for _ in range(max(SPARSE_EPOCHS, -(-SPARSE_STEPS * BATCH_ROWS // max(len(rows), 1)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH_ROWS):
            chosen = order[at : at + BATCH_ROWS]
            chosen = chosen[lengths[chosen] > 0]
            if not len(chosen):
                continue
            many = lengths[chosen]
            starts = np.cumsum(many) - many
            touched, places = np.unique(np.concatenate([rows[i] for i in chosen]), return_inverse=True)
            own, vectors = weights[touched], factors[touched]
            sums = np.add.reduceat(vectors[places], starts)
            squares = np.add.reduceat((vectors**2).sum(axis=1)[places], starts)
            raw = bias + np.add.reduceat(own[places], starts) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (_sigmoid(raw) - labels[chosen]) / len(chosen)
            step = np.bincount(places, np.repeat(error, many), len(touched))
            turned = np.stack([np.bincount(places, np.repeat(error * s, many), len(touched)) for s in sums.T], axis=1) - step[:, None] * vectors
            bias_sum += error.sum() ** 2
            bias -= WEIGHT_RATE * error.sum() / np.sqrt(bias_sum)
            weight_sums[touched] += step**2
            rate = WEIGHT_RATE / np.sqrt(weight_sums[touched])
            own = own - rate * step
            weights[touched] = np.sign(own) * np.maximum(np.abs(own) - WEIGHT_SHRINK * rate, 0)
            factor_sums[touched] += (turned**2).mean(axis=1, keepdims=True)
            rate = FACTOR_RATE / np.sqrt(factor_sums[touched])
            vectors = vectors - rate * turned
            norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            factors[touched] = vectors * np.maximum(1 - FACTOR_SHRINK * rate / norms, 0)
    norms = np.linalg.norm(factors, axis=1)
    return np.flatnonzero((norms >= LEAST_SHARE * norms.max()) & (norms > 0)) if size else np.zeros(0, np.int64)


def _ratios(n: np.ndarray, k: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio with the label of terms that are in n rows, k of them toxic."""
    part = lambda k, p: k * np.log(np.maximum(k, 1) / (n * p))
    return 2 * (part(k, share) + part(n - k, 1 - share))


def _featurized(batches):
    for batch in batches:
        found = []
        for text in utf8(batch.column(2)):
            buckets, times = np.unique(terms(text or b""), return_counts=True)
            found.append(np.union1d(buckets, repeated(buckets[times >= 2])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A model of the labels of rows whose crc32(doc_id as text) mod 3 is not 1.

    At most ``sample_rows`` labelled rows are used, those with the smallest hashes of their doc_id, so
    what is broadcast and what reaches the driver is bounded by that parameter. Rows without a doc_id,
    label or text are not used; a doc_id that repeats in ``docs`` counts with each of its rows, as far as the bound
    allows. The terms of all used rows reach the driver. Without rows of both labels the model only knows their share.
    """
    small_batches(docs)
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    given = given.filter("doc_id is not null and label is not null").filter(~is_fold("doc_id", 3, 1)).distinct()
    given = stage(given.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    held = texts.join(F.broadcast(given), "doc_id").select("doc_id", "label", "text")
    rows = stage(held.mapInArrow(_featurized, "doc_id long, label int, terms array<long>"), "terms")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("terms")).limit(sample_rows)
    size, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < size:
        return train([], np.full(size, float(bool(toxic))), np.zeros(0, np.int64))
    found = rows.select("label", F.col("terms").cast("array<int>").alias("terms")).toArrow()
    given = found.column("label").to_numpy().astype(float)
    held = arrays(found.column("terms"))
    del found
    n = np.zeros(BUCKETS, np.int64)
    k = np.zeros(BUCKETS, np.int64)
    for row, toxic_row in zip(held, given, strict=True):
        n[row] += 1
        if toxic_row:
            k[row] += 1
    known = np.flatnonzero(n >= LEAST_ROWS)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))
    in_pairs = known[paired([p[p >= 0] for p in (place[row] for row in held)], given, len(known))]
    once = np.flatnonzero(n)
    buckets = np.union1d(once[_ratios(n[once], k[once], toxic / size) >= LEAST_RATIO], in_pairs)
    place[:] = -1
    place[buckets] = np.arange(len(buckets))
    machine = train([p[p >= 0] for p in (place[row] for row in held)], given, buckets)
    del held
    release()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (doc_id, held_out, score, predicted); null and empty texts get the model's bias."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.buckets, machine.bias, machine.weights, machine.factors))

    def run(batches):
        own = Machine(*sent.value)
        for batch in batches:
            scores = [own.score(text or b"") for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    held = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model fitted on the labelled ones: (doc_id, held_out, score, predicted).

    A text's terms are its words, the first four to eight bytes of longer ones, and which of them come
    twice or more, hashed. The machine adds a weight per term and a product of factors per pair of terms, so it learns what is toxic only
    together, also where neither term says anything alone. Whole texts are scored, all terms of them. Rows that repeat each get a row; a null doc_id
    is in no fold. Empty tables give empty results. Other columns are ignored.
    """
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns; texts go through the model in place."""
    machine = fit(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((machine.buckets, machine.bias, machine.weights, machine.factors))
    at = docs.columns.index(text_col)

    def run(batches):
        own = Machine(*sent.value)
        for batch in batches:
            keep = [own.score(text or b"") < REJECT for text in utf8(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
