"""Quality scores by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import is_fold, small_batches, utf8
from storelens.session import stage

#: Labelled rows that the model is fitted on at most, per label, chosen by a hash of the doc_id.
SAMPLE_ROWS = 6_000
#: One of so many sampled rows calibrates, the others fill the dictionaries.
PARTS = 3
#: Bytes per compressed part of a text; parts of one text and of one label that fill a dictionary at most, chosen by hash.
SEGMENT, TEXT_SEGMENTS, SEGMENTS = 1024, 16, 16_000
DICTIONARY_BYTES, LEVEL = 112_640, 3
ACCEPT = 0.7


def segments(text: bytes) -> list[bytes]:
    """The whole text in parts of ``SEGMENT`` bytes, so that a dictionary tells as much of its end as of its start."""
    return [text[at : at + SEGMENT] for at in range(0, len(text), SEGMENT)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = None
    if content:
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    """score = sigmoid(slope * difference + base); without a dictionary of each label the difference is 0."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    base: float = 0.0
    _ready: list = field(default_factory=list, repr=False)

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good) of the compressed sizes, from -1 to 1: higher if text is more like good text."""
        if not text or not (self.good and self.bad):
            return 0.0
        if not self._ready:
            self._ready = [_compressor(self.good), _compressor(self.bad)]
        with_good, with_bad = (sum(len(c.compress(part)) for part in segments(text)) for c in self._ready)
        return (with_bad - with_good) / (with_bad + with_good)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.base, -40, 40))))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and base of the logistic curve of y over x, by Newton steps; the slope is never negative."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2 or not x.std():
        return 0.0, base
    center, spread = x.mean(), x.std()
    design = np.stack([(x - center) / spread, np.ones(len(x))], axis=1)
    weights, penalty = np.array([0.0, base]), np.diag([ridge, 0.0]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        gradient = design.T @ (p - y) + penalty @ weights
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(2), gradient)
        weights = weights - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = weights[0] / spread
    return (float(slope), float(weights[1] - slope * center)) if slope > 0 else (0.0, base)


def _sampled_segments(batches):
    for batch in batches:
        labels, order, parts = [], [], []
        for doc, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            found = sorted((xxhash.xxh3_64_intdigest(f"{doc} {i}") >> 1, part) for i, part in enumerate(segments(text)))
            for key, part in found[:TEXT_SEGMENTS]:
                labels.append(label)
                order.append(key)
                parts.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(order, pa.int64()), pa.array(parts, pa.binary())], ["label", "key", "part"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labels of rows whose crc32(doc_id as text) mod 4 is not 2.

    At most ``sample_rows`` rows of each label are used, those with the smallest hashes of their doc_id; a
    doc_id that repeats in ``docs`` counts once, with the smallest of its texts. Two thirds of them give
    parts of their texts, bounded per text and label, to the dictionaries. The rest, whose texts no dictionary
    has seen, calibrates: only its differences reach the driver. Rows without a doc_id, label or text are not used.
    """
    small_batches(docs)
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    given = given.filter("doc_id is not null and label in (0, 1)").filter(~is_fold("doc_id", 4, 2)).distinct()
    chosen = [given.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for v in (0, 1)]
    sample = stage(chosen[0].union(chosen[1]), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    # The labels of a sample are a short list of bounded length.
    held = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    held = stage(held.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(PARTS)) == 0), "sample")

    parts = stage(held.filter("not calibrates").select("doc_id", "label", "text").mapInArrow(_sampled_segments, "label int, key long, part binary"), "parts")
    contents = []
    for value in (1, 0):
        rows = parts.filter(F.col("label") == value).orderBy("key", "part").limit(SEGMENTS).select("part").toArrow()
        contents.append(dictionary([bytes(p) for p in rows.column("part").to_pylist()]))
    model = Model(*contents)
    if not (model.good and model.bad):
        n, good = held.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        model.base = calibrated(np.zeros(n), np.array([1.0] * good + [0.0] * (n - good)))[1]
        return model
    sent = docs.sparkSession.sparkContext.broadcast((model.good, model.bad))

    def differences(batches):
        own = Model(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.difference(t) for t in utf8(batch.column(1))], pa.float64())], ["label", "difference"]
            )

    rows = held.filter("calibrates").select("label", "text").mapInArrow(differences, "label int, difference double")
    # Summed in a fixed order, so that the same rows give the same model.
    found = rows.orderBy("difference", "label").toArrow()
    sent.unpersist()
    # The sample takes as many rows of the rarer label as there are; the share among all labelled rows is counted.
    good, n = given.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    y = found.column("label").to_numpy().astype(float)
    slope, base = calibrated(found.column("difference").to_numpy(), y)
    if 0 < y.sum() < len(y):
        base += float(np.log(good / (n - good)) - np.log(y.sum() / (len(y) - y.sum())))
    model.slope, model.base = slope, base
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (doc_id, held_out, score, predicted); null and empty texts have difference 0."""
    sent = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.slope, model.base))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            scores = [own.score(text or b"") for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    held = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of all documents by a model fitted on the labelled ones: (doc_id, held_out, score, predicted).

    Whole texts are compressed part by part, once with a zstandard dictionary of good and once with one of
    bad text; the normalised difference of the two sums goes through a logistic curve that was fitted on
    labelled rows outside the dictionaries. Rows that repeat each get a row; a null doc_id is in no fold.
    Null and empty texts get the score of difference 0. Without texts of both labels every score is the
    smoothed share of label 1. Empty tables give empty results. Other columns are ignored.
    """
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
