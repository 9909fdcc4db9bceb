"""Alignment of two tokenizers' tokens by merging their byte ends."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.bpe import MAX_FILE_BYTES, PATTERN, byte_symbols, grouped
from storelens.llm.common import small_batches, utf8
from storelens.session import stage

#: Merge steps per piece: both sides of a piece fit into a processor's cache.
STEPS = 1 << 15
#: Id pairs that are looked up by broadcast at most, those that documents link most often; all others are joined.
HOT_PAIRS = 100_000
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


class ByteLevel:
    """A byte-level BPE vocabulary file whose merges are in the order of their ids."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        symbols = byte_symbols()
        vocab = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if all(c in symbols for c in token)}
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        made = [model["vocab"][x + y] for x, y in pairs]
        if made != sorted(made) or len(set(made)) < len(made) or any(i >= made[0] for t, i in vocab.items() if len(t) == 1):
            raise ValueError("merges must be in the order of their ids")
        made = set(made)
        ranks = {token: i for token, i in vocab.items() if len(token) == 1 or i in made}
        self.encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(text) for text in texts]


class Pieces:
    """A sentencepiece model; U+2581 stands for a space, byte pieces for their byte."""

    def __init__(self, content: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def diagonals(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of each side the merge has taken after every ``steps`` steps, and at its end.

    All diagonals are searched at once: on diagonal d the path passes where i + d - i ends are taken and
    the i-th of a is the first above the last taken one of b. Of equal ends a's comes first.
    """
    d = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        further = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(d - middle - 1, 0, len(b) - 1)])
        low, high = np.where(further, middle + 1, low), np.where(open_ & ~further, middle, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Links (i, j) whose last common byte lies in a piece of the merge, and the common ends of both sides there.

    A piece reads its own ends and one neighbour on each side, so pieces don't depend on each other.
    """
    mine, theirs = a[i0:i1], b[j0:j1]
    over = np.searchsorted(theirs, mine, "left") + j0  # the token of b around the byte before an end of a
    equal = b[over] == mine
    under = np.searchsorted(mine, theirs, "left") + i0
    apart = a[np.minimum(under, len(a) - 1)] != theirs
    if i0 and j0 < j1:
        apart[0] &= a[i0 - 1] != b[j0]  # the equal end was taken by the piece before
    i = np.concatenate([np.arange(i0, i1), under[apart]])
    j = np.concatenate([over, np.arange(j0, j1)[apart]])
    return i, j, np.arange(i0, i1)[equal], over[equal]


@dataclass
class Alignment:
    """Links, and per token of each side its group; groups that span pieces have one number."""

    i: np.ndarray
    j: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def merged(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> Alignment:
    """Alignment of two sides given by their tokens' byte ends, which end at the same byte."""
    at_a, at_b = diagonals(a, b, steps)
    found = [overlaps(a, b, *span) for span in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:])]
    i, j, cut_a, cut_b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    # Stitching: a piece's first group goes on from the last one that was closed before it.
    groups = []
    for size, cuts in ((len(a), cut_a), (len(b), cut_b)):
        closed = np.zeros(size, np.int64)
        closed[cuts] = 1
        groups.append(np.cumsum(closed) - closed)
    return Alignment(i, j, *groups)


def digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size`` as rows of bytes, ended by zeros, and room for a separator."""
    width = len(str(max(size - 1, 0)))
    table = np.zeros((size, width + 1), np.uint8)
    for i in range(size):
        name = str(i).encode()
        table[i, : len(name)] = np.frombuffer(name, np.uint8)
    return table, (table > 0).sum(axis=1)


def spelled(ids_a, ids_b, group_a, group_b, tables, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of all documents of a batch, joined, and the length up to each of ``last_b`` tokens of b."""
    n = len(ids_a) + len(ids_b)
    in_a, in_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    place_a, place_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + (before_a + in_a)[group_b]
    width = max(tables[0][0].shape[1], tables[1][0].shape[1])
    chars, lengths = np.zeros((n, width), np.uint8), np.zeros(n, np.int64)
    marks = []
    for ids, group, place, (table, sizes), end in ((ids_a, group_a, place_a, tables[0], ord("|")), (ids_b, group_b, place_b, tables[1], ord(";"))):
        chars[place, : table.shape[1]] = table[ids]
        mark = np.where(np.append(group[1:] != group[:-1], True), end, ord(",")).astype(np.uint8)
        marks.append(mark)
        lengths[place] = sizes[ids]
    marks[1][last_b] = 0
    for mark, place in zip(marks, (place_a, place_b)):
        chars[place, lengths[place]] = mark
        lengths[place] += mark > 0
    return chars[chars > 0].tobytes(), np.cumsum(lengths)[place_b[last_b]]


class Aligner:
    def __init__(self, a: bytes, b: bytes, steps: int = STEPS):
        self.a, self.b, self.steps = ByteLevel(a), Pieces(b), steps
        self.sizes = [np.array([len(x) for x in side.bytes_of], np.int64) for side in (self.a, self.b)]
        self.tables = [digits(len(side.bytes_of)) for side in (self.a, self.b)]

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text (n_a, n_b, n_groups, n_links, groups, pairs, times)."""
        led = [" " + text for text in texts]
        sides = [self.a.encode(led), self.b.encode(texts)]
        used = []
        for k, (text, a, b) in enumerate(zip(led, *sides)):
            data = text.encode()
            same = texts[k] and all(b"".join(map(side.bytes_of.__getitem__, ids)) == data for side, ids in ((self.a, a), (self.b, b)))
            if same:
                used.append(k)
        out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
        if not used:
            return out
        ids = [np.concatenate([np.array(side[k], np.int64) for k in used]) for side in sides]
        counts = [np.array([len(side[k]) for k in used]) for side in sides]
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        found = merged(*ends, self.steps)
        doc_a, doc_b = (np.repeat(np.arange(len(used)), n) for n in counts)
        last_a, last_b = (np.cumsum(n) - 1 for n in counts)
        text, stops = spelled(*ids, found.group_a, found.group_b, self.tables, last_b)
        names = [text[x:y].decode() for x, y in zip([0, *stops[:-1].tolist()], stops.tolist())]
        groups = np.diff(np.append(-1, found.group_a[last_a]))
        doc = doc_a[found.i]
        links = np.bincount(doc, minlength=len(used))
        width = len(self.b.bytes_of)
        keys, times = np.unique((doc * len(self.a.bytes_of) + ids[0][found.i]) * width + ids[1][found.j], return_counts=True)
        owner, pair = np.divmod(keys, len(self.a.bytes_of) * width)
        pair = ((pair // width) << 32) | (pair % width)
        bounds = np.searchsorted(owner, np.arange(len(used) + 1))
        for x, k in enumerate(used):
            part = slice(bounds[x], bounds[x + 1])
            out[k] = (int(counts[0][x]), int(counts[1][x]), int(groups[x]), int(links[x]), names[x], pair[part], times[part].astype(np.int32))
        return out


def _file(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError("the vocabulary file is too large to be sent to every worker")
    return content


def _loaded(a: bytes, b: bytes, steps: int) -> Aligner:
    """The worker's vocabularies, kept from task to task."""
    held = sys.modules["__main__"].__dict__.setdefault("_aligners", {})
    key = (hash(a), hash(b), steps)
    if key not in held:
        held.clear()
        held[key] = Aligner(a, b, steps)
    return held[key]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """Tokens of every whole text by two tokenizers, cut into groups where both end at the same byte.

    A encodes a space and the text by a byte-level BPE vocabulary file, B the text by a sentencepiece model
    that adds that space itself. Per row: doc_id, n_a, n_b, n_groups, n_links (pairs of an A and a B token
    that share a byte), groups (``a1,a2|b1;a3|b2,b3`` in ids), and the distinct id pairs linked (A id times 2^32 plus
    B id) with how often. The ends of a batch's documents are one merge, cut by binary searches on its
    diagonals into pieces of ``steps`` steps that don't depend on each other; a long text is many pieces.

    Null and empty texts, and texts whose tokens don't spell the text again, have no tokens. Rows that
    repeat each get a row. Strings of special tokens are plain text. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((_file(a_path), _file(b_path)))

    def run(batches):
        own = _loaded(*sent.value, steps)
        for batch in batches:
            at, texts = 0, [(text or b"").decode() for text in utf8(batch.column(1))]
            for group in grouped(texts):
                columns = list(zip(*own.align(group)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), *arrays], [f.split()[0] for f in SCHEMA.split(", ")])
                at += len(group)

    held = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, SCHEMA)


def _looked_up(sent):
    def run(batches):
        keys, counts, best = sent.value
        for batch in batches:
            pairs, times = (batch.column(k).values.to_numpy() for k in (1, 2))
            lengths = batch.column(1).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hot = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, of, n = at[hot], row[hot], times[hot].astype(np.int64)
            sums, firsts = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            np.add.at(sums, of, n * counts[at])
            np.add.at(firsts, of, n * best[at])
            offsets = np.append(0, np.cumsum(np.bincount(row[~hot], minlength=len(lengths)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hot])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts), pa.array(sums), *rest], ["row", "n_best", "count_sum", "pairs", "times"])

    return run


def counted(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Alignments with how common their links are in the whole corpus.

    An id pair's count is the number of rows that hold it linked. Adds n_best (links whose count is the
    highest of their A id, ties included) and count_sum (over links), drops pairs and times; other columns stay.

    The counts are one aggregation. Of all (row, pair) entries, a pair with at least one in ``hot_pairs`` of them is
    looked up by broadcast: there are at most ``hot_pairs`` such. The others are joined, so no key of
    that join holds more than one in ``hot_pairs`` of all entries.
    """
    spark = aligned.sparkSession
    held = stage(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stage(counts.withColumn("a", F.shiftright("pair", 32)), "counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    ranked = stage(counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "ranked")
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = ranked.filter(F.col("n") * hot_pairs >= F.lit(total)).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    kinds = "row long, n_best long, count_sum long, pairs array<long>, times array<int>"
    found = stage(held.select("row", "pairs", "times").mapInArrow(_looked_up(sent), kinds), "looked_up")
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("post")).select("row", "post.*")
    rest = rest.join(ranked.filter(F.col("n") * hot_pairs < F.lit(total)), rest["pairs"] == ranked["pair"])
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("best_rest"), F.sum(F.col("times") * F.col("n")).alias("sum_rest")
    )
    sums = found.select("row", "n_best", "count_sum").join(rest, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("best_rest", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_rest", F.lit(0))).alias("count_sum")
    )
    return held.drop("pairs", "times").join(sums, "row").drop("row")


def digests(aligned: DataFrame) -> DataFrame:
    """The groups' spelling as its SHA-256; '' for texts without tokens."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "utf-8"), 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")
