"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import arrays, is_fold, release, small_batches, utf8
from storelens.session import stage

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
#: Rows that the model is fitted on at most, chosen by a hash of the doc_id; a fifth of them calibrates it.
SAMPLE_ROWS = 4_000
DIMENSIONS, EPOCHS, BATCH_ROWS, RATE = 16, 6, 32, 0.5
#: The calibrated score under which a language is rejected keeps this share of the calibration rows, and is 0.5 at most.
KEPT_SHARE = 0.999
UNKNOWN = "und"
PART = 1 << 16

#: Digits, punctuation and white space in ASCII separate subwords alike; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTOR = np.uint32(0x9E3779B1)


def subwords(text: bytes) -> np.ndarray:
    """Hash buckets of the byte sequences of 2 to 4 letters, with a word's border as a letter."""
    codes = np.frombuffer(b" " + text.translate(_TABLE) + b" ", np.uint8).astype(np.uint32)
    space = codes == 32
    # Runs of separators count as one.
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    out, value = [], codes
    for size in range(2, max(SIZES) + 1):
        value = value[:-1] * np.uint32(257) + codes[size - 1 :] if len(codes) >= size else value[:0]
        if size in SIZES:
            out.append(((value + np.uint32(size)) * _FACTOR) >> np.uint32(32 - 15))
    found = np.concatenate(out) if out else np.zeros(0, np.uint32)
    return found.astype(np.int64)


def counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs in a whole text, read in parts."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), PART):
        total += np.bincount(subwords(text[at : at + PART]), minlength=BUCKETS)
    return total


@dataclass
class Model:
    """logits[b] are the class scores of bucket b (embedding times the softmax weights), averaged over a text."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    scale: float
    threshold: float

    def raw(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), PART):
            found = subwords(text[at : at + PART])
            total += self.logits[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return total / max(n, 1) + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        chance = _softmax(self.raw(text)[None] * self.scale)[0]
        best = int(chance.argmax())
        return self.languages[best], float(chance[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    """rows: buckets and their shares of each text. Every fifth row is left out of the descent and calibrates."""
    rng = np.random.default_rng(seed)
    many = len(languages)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, many)), np.zeros(many)
    own = [i for i in range(len(rows)) if i % 5 or len(rows) < 25]
    steps = max(1, EPOCHS * len(own))
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(own) if own else []
        for at in range(0, len(order), BATCH_ROWS):
            chosen = [i for i in order[at : at + BATCH_ROWS] if len(rows[i][0])]
            if not chosen:
                continue
            ids, shares = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in chosen[:-1])])
            mean = np.add.reduceat(table[ids] * shares[:, None], starts)
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(chosen)), targets[chosen]] -= 1
            error /= len(chosen)
            back = np.repeat(error @ weights.T, np.diff([*starts, len(ids)]), axis=0) * shares[:, None]
            rate = RATE * (1 - done / steps) * len(chosen)
            weights -= rate / len(chosen) * 4 * (mean.T @ error)
            bias -= rate / len(chosen) * error.sum(axis=0)
            np.add.at(table, ids, -rate * 4 * back)
            done += len(chosen)
    model = Model(languages, (table @ weights).astype(np.float32), bias, 1.0, 0.0)
    checks = [i for i in range(len(rows)) if i % 5 == 0 and len(rows[i][0])]
    if checks and many:
        raw = np.array([(model.logits[rows[i][0]] * rows[i][1][:, None]).sum(axis=0) + bias for i in checks])
        scales = np.geomspace(0.25, 16, 25)
        losses = [-np.log(_softmax(raw * s)[np.arange(len(checks)), targets[checks]] + 1e-12).mean() for s in scales]
        model.scale = float(scales[int(np.argmin(losses))])
        model.threshold = min(0.5, float(np.quantile(_softmax(raw * model.scale).max(axis=1), 1 - KEPT_SHARE)))
    return model


def _featurized(batches):
    for batch in batches:
        ids, shares = [], []
        for text in utf8(batch.column(2)):
            total = counts(text)
            at = np.flatnonzero(total)
            ids.append(at.astype(np.int32))
            shares.append((total[at] / max(total.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["doc_id", "lang", "ids", "shares"],
        )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``lang`` learned from documents whose crc32(doc_id as text) mod 5 is not 0.

    At most ``sample_rows`` rows are used, those with the smallest hashes of their doc_id; that bounds
    what reaches the driver, where numpy runs the descent. Rows without a doc_id, text or lang are not used.
    """
    small_batches(docs)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    own = own.filter("doc_id is not null and lang is not null and text is not null").filter(~is_fold("doc_id", 5, 0))
    keys = stage(own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "keys")
    held = own.join(F.broadcast(keys), "doc_id").select("doc_id", "lang", "text")
    rows = stage(held.mapInArrow(_featurized, "doc_id long, lang string, ids array<int>, shares array<float>"), "subwords")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample_rows).select("lang", "ids", "shares").toArrow()
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    pairs = list(zip(*(arrays(found.column(c)) for c in ("ids", "shares"))))
    del found
    model = train(pairs, np.array([languages.index(x) for x in names], np.int64), languages)
    del pairs
    release()
    return model


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.logits, model.bias, model.scale, model.threshold))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (doc_id, held_out, lang_pred, score, accepted) of the whole text."""
    sent = _sent(docs, model)

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            found = [own.predict(text) if text is not None else (UNKNOWN, 0.0) for text in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                ["doc_id", "lettered", "lang_pred", "score"],
            )

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    held = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), lettered.alias("lettered"), F.col(text_col).alias("text"))
    found = held.mapInArrow(run, "doc_id long, lettered boolean, lang_pred string, score double")
    score = F.when(F.col("lettered"), F.col("score")).otherwise(0.0)
    return found.select(
        "doc_id", is_fold("doc_id", 5, 0).alias("held_out"),
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"),
        (F.col("lettered") & (score >= model.threshold) & (F.col("lang_pred") != UNKNOWN)).alias("accepted"),
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicted language of every document: (doc_id, held_out, lang_pred, score, accepted).

    A text is the mean of the embeddings of its hashed subwords; a softmax over it gives the language.
    score is the softmax at a temperature that calibration rows chose; accepted is false for ``und``
    and for scores under the calibrated threshold. Null texts and texts without a letter are ``und``
    with score 0, as are all texts if there is nothing to learn from. Whole texts are read, long ones in
    parts. Rows that repeat each get a row; a null doc_id is in no fold. Other columns are ignored.
    """
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is accepted, with all their columns. With nothing to learn from, those with a letter."""
    model = fit(docs, id_col, text_col, lang_col)
    sent, at = _sent(docs, model), docs.columns.index(text_col)

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            keep = [not own.languages or own.predict(text)[1] >= own.threshold for text in utf8(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    lettered = small_batches(docs).filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return lettered.mapInArrow(run, docs.schema)
