"""Phrases that many texts use, mined from a sample and a negative border and counted exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import mix, odd_numbers, small_batches, utf8, word_hashes
from storelens.session import stage

LONGEST, LEAST, TOP = 5, 100, 2000
#: Share of the rows that proposes phrases, by a hash of id and text; it grows with the input.
SAMPLE = 1 / 8
#: The sample's threshold lies so many standard deviations under its expected share of the full one.
DEVIATIONS = 2.0
#: Bits of a phrase's key, and of the filter for each key: its size is a power of two between the two given ones (128 KB, 128 MB).
KEY_BITS, BITS_EACH, SMALLEST_BITS, LARGEST_BITS = 44, 24, 20, 30
NO_PART = np.uint64(1 << KEY_BITS)
#: A place's mark: bits of a second hash of its phrase, which tell phrases of one key apart, above bits of its row's hash.
CHECK_BITS, ROW_BITS = 31, 12
#: Entries that a task sums up before it sends them on, and bytes of text it looks at together.
HELD, GROUP = 1 << 20, 1 << 20
_PLACES = odd_numbers(LONGEST, 0xBF58476D1CE4E5B9)
_AGAIN = odd_numbers(LONGEST, 0x5851F42D4C957F2D)
#: Letters lower-cased, ``[.,;:!?\x0A-\x0D]`` as line ends, tabs as spaces.
_TABLE = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words:
    """Words of texts of one language, and a key of every phrase of up to ``LONGEST`` words.

    ``keys[k - 1]`` has the keys of k words from every place, ``valid[k - 1]`` whether they lie in one piece,
    ``rows`` a few bits of the hash of the row that each word is from.
    """

    def __init__(self, lang: str, texts: list[bytes], rows: list[int] | None = None):
        self.lang, self.text = lang, b"\n".join(texts).translate(_TABLE)
        codes = np.frombuffer(self.text, np.uint8)
        word = (codes != 32) & (codes != 10)
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(codes == 10)[self.starts] if len(codes) else self.starts
        self.hashed = word_hashes(self.text)
        ends = np.searchsorted(self.starts, np.cumsum([len(text) + 1 for text in texts]))
        self.rows = np.repeat(np.array(rows or [0] * len(texts), np.uint64), np.diff(ends, prepend=0))
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
        self.valid, self.keys = [], []
        total = np.zeros(len(self.hashed), np.uint64)
        for k in range(1, LONGEST + 1):
            n = max(len(self.hashed) - k + 1, 0)
            total = total[:n] + self.hashed[k - 1 : k - 1 + n] * _PLACES[k - 1]
            self.valid.append(piece[:n] == piece[k - 1 : k - 1 + n])
            self.keys.append(mix(total + seed + np.uint64(k)) >> np.uint64(64 - KEY_BITS))
        # The longest phrases are no part of others; their keys are told from those of parts.
        self.keys[-1] |= NO_PART

    def marks(self):
        """The marks of k words from every place, for k from 1 to ``LONGEST``."""
        again = np.zeros(len(self.hashed), np.uint64)
        for k in range(1, LONGEST + 1):
            n = max(len(self.hashed) - k + 1, 0)
            again = again[:n] + self.hashed[k - 1 : k - 1 + n] * _AGAIN[k - 1]
            yield again >> np.uint64(64 - CHECK_BITS) << np.uint64(ROW_BITS) | self.rows[:n]

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.text[self.starts[at] : self.ends[at + k - 1]].split())

    def times(self, at: np.ndarray, k: int):
        """First place and number of the distinct phrases of k words at the given places; phrases of one key are told apart."""
        _, first, group, n = np.unique(self.keys[k - 1][at], return_index=True, return_inverse=True, return_counts=True)
        # A second sum of the words' hashes, by other factors: where it differs within a key, the texts decide.
        again = np.zeros(len(at), np.uint64)
        for j in range(k):
            again += self.hashed[at + j] * _AGAIN[j]
        odd = np.unique(group[again != again[first][group]])
        plain = ~np.isin(np.arange(len(n)), odd)
        yield from zip(at[first[plain]].tolist(), n[plain].tolist())
        for g in odd.tolist():
            apart: dict[bytes, list[int]] = {}
            for x in at[group == g].tolist():
                apart.setdefault(self.phrase(x, k), []).append(x)
            yield from ((places[0], len(places)) for places in apart.values())


class Filter:
    """A set of keys in a fixed number of bits, three per key. It may take in others, but never leaves one out."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        spread = mix(keys + np.uint64(1))
        return [(spread >> np.uint64(shift)) & mask for shift in (0, 17, 34)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in self.places(keys, self.mask):
            byte = self.bits[(place >> np.uint64(3)).astype(np.int64)]
            found &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _words(batches):
    """Words of the batches' texts by language, of about ``GROUP`` bytes at a time."""
    for batch in batches:
        texts: dict[str, tuple[list[bytes], list[int]]] = {}
        for lang, text, row in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            held, rows = texts.setdefault(lang, ([], []))
            held.append(text)
            rows.append(row)
            if sum(map(len, held)) >= GROUP:
                yield Words(lang, *texts.pop(lang))
        for lang, (held, rows) in texts.items():
            yield Words(lang, held, rows)


def _summed(found):
    """Batches of keys with their numbers, summed over about ``HELD`` entries at a time."""
    held, size = [], 0

    def flush():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "n"])

    for keys in found:
        held.append(keys)
        size += len(keys)
        if size >= HELD:
            yield flush()
            size = 0
    if held:
        yield flush()


def _marked(found):
    """Batches of keys with their numbers and least marks, summed as in ``_summed``; a key of two phrases has a row with its largest mark, too."""
    held, size = [], 0

    def flush():
        keys, marks = (np.concatenate(parts) for parts in zip(*held))
        held.clear()
        order = np.argsort(keys)
        keys, marks = keys[order], marks[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[first], np.diff(first, append=len(keys))
        low, high = np.minimum.reduceat(marks, first), np.maximum.reduceat(marks, first)
        mixed = low >> np.uint64(ROW_BITS) != high >> np.uint64(ROW_BITS)
        columns = [np.concatenate((keys, keys[mixed])).astype(np.int64), np.concatenate((n, np.zeros(mixed.sum(), np.int64))), np.concatenate((low, high[mixed])).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "n", "mark"])

    for keys, marks in found:
        if len(keys):
            held.append((keys, marks))
            size += len(keys)
        if size >= HELD:
            yield flush()
            size = 0
    if held:
        yield flush()


def _first_proposals(batches):
    """Keys of all words and pairs of words."""
    yield from _summed(words.keys[k][words.valid[k]] for words in _words(batches) for k in range(2))


def _longer_proposals(sent):
    """Keys of the longer phrases in which every pair of words is proposed."""

    def keys(batches):
        now = Filter(sent.value)
        for words in _words(batches):
            pairs = words.valid[1] & now.holds(words.keys[1])
            at = np.flatnonzero(pairs)
            for k in range(3, LONGEST + 1):
                at = at[at < len(words.keys[k - 1])]
                at = at[pairs[at + k - 2] & words.valid[k - 1][at]]
                yield words.keys[k - 1][at]

    return lambda batches: _summed(keys(batches))


def _candidates(sent):
    """Keys and marks of the proposed phrases and of their negative border.

    A phrase is one of these if its first and its last words without one are proposed: then it is proposed
    itself or on the border. What an earlier pass has counted is left out. The first pass counts all words.
    """

    def keys(batches):
        earlier, now = (Filter(bits) if bits is not None else None for bits in sent.value)
        for words in _words(batches):
            marks = list(words.marks())
            if earlier is None:
                yield words.keys[0], marks[0]
            for k in range(2, LONGEST + 1):
                parts = words.keys[k - 2]
                held = now.holds(parts)
                at = np.flatnonzero(words.valid[k - 1] & held[:-1] & held[1:])
                if earlier is not None:
                    at = at[~(earlier.holds(parts[at]) & earlier.holds(parts[at + 1]))]
                yield words.keys[k - 1][at], marks[k - 1][at]

    return lambda batches: _marked(keys(batches))


def _spelled(sent):
    """Texts of phrases with their keys: those of plain keys from their chosen rows, those of mixed keys from everywhere, and the number of words."""

    def run(batches):
        (plain, mixed), held, size = (Filter(bits) for bits in sent.value), [], 0
        names = ["key", "again", "lang", "phrase", "words"]

        def flush():
            rows = pa.Table.from_batches(held).group_by(names).aggregate([("n", "sum")])
            held.clear()
            return rows.select([*names, "n_sum"]).rename_columns([*names, "n"]).combine_chunks().to_batches()

        for words in _words(batches):
            rows = [(None, None, None, 0, len(words.starts))]
            for k, marks in enumerate(words.marks(), 1):
                keys = words.keys[k - 1]
                wanted = plain.holds(keys | words.rows[: len(keys)] << np.uint64(KEY_BITS + 1))
                if mixed.bits.any():
                    wanted |= mixed.holds(keys)
                at = np.flatnonzero(words.valid[k - 1] & wanted)
                rows += [(int(keys[x]), int(marks[x]) >> ROW_BITS, words.phrase(x, k), k, n) for x, n in words.times(at, k)]
            key, again, phrase, k, n = zip(*rows)
            spelled = [pa.array([words.lang] * len(rows), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(k, pa.int32())]
            held.append(pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(again, pa.int64()), *spelled, pa.array(n, pa.int64())], [*names, "n"]))
            size += len(rows)
            if size >= HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _set_bits(keys: DataFrame, bits: np.ndarray) -> np.ndarray:
    """The filter's bits with those of further keys. They are merged to words of 64 bits before they come to the driver, never more than the filter has."""
    mask = len(bits) * 8 - 1

    def run(batches):
        for batch in batches:
            place = np.unique(np.concatenate(Filter.places(batch.column(0).to_numpy().view(np.uint64), np.uint64(mask))))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["at", "bit"]
            )

    found = keys.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = bits.copy().view("<u8")
    words[found.column("at").to_numpy()] |= found.column("bit").to_numpy().view(np.uint64)
    return words.view(np.uint8)


def _room(size: int) -> np.ndarray:
    """An empty filter for ``size`` keys, of bounded size."""
    power = min(LARGEST_BITS, max(SMALLEST_BITS, math.ceil(math.log2(size * BITS_EACH + 1))))
    return np.zeros(1 << (power - 3), np.uint8)


def count_phrases(docs: DataFrame, least: int = LEAST, sample: float = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, phrase, words, n of all phrases of 1 to 5 words with n >= ``least``; totals: lang, n of words).

    1. A sample of the rows proposes the phrases that are frequent in it by a lowered threshold.
    2. A pass over all rows counts the proposed phrases and their negative border, and all words, by key.
    3. A border phrase that is frequent is a failure: it may be part of longer ones. It joins the proposals,
       and a further pass counts what is now proposed or on the border and was not before, until no border
       phrase fails. Then by induction over the length every frequent phrase has been counted.
    4. A last pass reads the texts of frequent phrases. Each place has a mark beside its key: a second hash of its phrase
       above a few bits of its row's hash. A key whose places agree in the second hash has one phrase: its text is read from the
       rows with the least of those bits alone, so its rows don't grow with the tasks that hold it. A key of several phrases is
       counted by their texts, so that equal keys make no difference.

    Phrases are the same if both hashes are, 75 bits of sums over 64-bit hashes of their words. Proposals and frequent
    keys travel as filters of bounded size. Phrases that these wrongly hold are counted as well, which costs time and changes no result. Only sums over about a million entries are shuffled.
    """
    docs = small_batches(docs)
    send = docs.sparkSession.sparkContext.broadcast
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    pick = F.pmod(hashed, F.lit(1 << 20)) < int(sample * (1 << 20))
    row = F.shiftright(hashed, 20).bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), row.alias("row"), pick.alias("pick"))
    texts = texts.filter("text is not null")
    few, texts = texts.filter("pick").select("lang", "text", "row"), texts.select("lang", "text", "row")
    lowered = max(1, math.floor(sample * least - DEVIATIONS * math.sqrt(sample * least)))

    def frequent(rows: DataFrame, function, threshold: int, name: str) -> DataFrame:
        summed = rows.mapInArrow(function, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return stage(summed.filter(F.col("n") >= threshold).select("key"), name)

    def counted(rows: DataFrame, function) -> DataFrame:
        # The tasks have summed up; what little more a task could do would cost more than it saves.
        summed = rows.mapInArrow(function, "key long, n long, mark long").repartition("key").groupBy("key").agg(
            F.sum("n").alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high")
        )
        return stage(summed.filter(F.col("n") >= least), "frequent")

    short = frequent(few, _first_proposals, lowered, "proposed")
    bits = _set_bits(short, _room(2 * short.count()))
    sent = send(bits)
    earlier, now = None, _set_bits(frequent(few, _longer_proposals(sent), lowered, "proposed"), bits)
    sent.destroy()
    found = None
    while True:
        sent = send((earlier, now))
        more = counted(texts, _candidates(sent))
        sent.destroy()
        found = more if found is None else found.union(more)
        grown = _set_bits(more.filter(F.col("key") < int(NO_PART)), now)
        if np.array_equal(grown, now):
            break
        earlier, now = now, grown
    # Phrases of one key may have been counted by different passes.
    found = found.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("mark"), F.max("high").alias("high"))
    one = F.shiftright("mark", ROW_BITS) == F.shiftright("high", ROW_BITS)
    found = stage(found.select("key", "n", "mark", one.alias("one")), "found")
    plain, mixed = found.filter("one"), found.filter("not one").select("key")
    row = F.col("mark").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    pairs = plain.select(F.col("key").bitwiseOR(F.shiftleft(row, KEY_BITS + 1)).alias("key"))
    sent = send(tuple(_set_bits(keys, _room(keys.count())) for keys in (pairs, mixed)))
    spelled = stage(texts.mapInArrow(_spelled(sent), "key long, again long, lang string, phrase string, words int, n long"), "spelled")
    sent.destroy()
    plain = plain.select("key", "n", F.shiftright("mark", ROW_BITS).alias("again"))
    once = spelled.drop("n").distinct().join(plain, ["key", "again"]).select("lang", "phrase", "words", "n")
    apart = spelled.join(mixed, "key", "left_semi").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    phrases = stage(once.union(apart.filter(F.col("n") >= least)), "phrases")
    return phrases, spelled.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut: (lang, phrase, words, a, l, r, n, score).

    All arithmetic is on decimals of 38 digits: 1000 * a * n has at most that many for corpora under 10^17 words.
    """
    many = phrases.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    split = F.split("phrase", " ")
    cuts = many.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "lang", "phrase", "words", "a", "k",
        F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r", "n", "a", "words")).alias("cut")
    )
    return least.select("lang", "phrase", "cut.words", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a, ...) without those inside a longer one that occurs as often.

    A longer one at any distance has one of a word more between, which occurs as often, too, so only those are looked at.
    """
    split = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(split, F.lit(at), F.col("words") - 1), " ") for at in (1, 2)])
    inside = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, sample: float = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words.
    Phrases of 2 to 5 words that occur ``least`` times are candidates; see ``count_phrases``, ``scored`` and
    ``maximal``. A null language is ``und``; null, empty and blank texts have no words; rows that repeat
    count each time, also under one id; very long texts are counted whole. Empty tables give no rows.
    Other columns are ignored. Ties in score and a go by the phrase's bytes.
    """
    phrases, totals = count_phrases(docs, least, sample, id_col, text_col, lang_col)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = maximal(scored(phrases, totals)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
phrases AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS a
  FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)
  GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cuts AS (
  SELECT p.lang, p.phrase, p.words, p.a, k, l.a AS l, r.a AS r, t.n,
         (1000::HUGEINT * p.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM phrases WHERE words >= 2) p
  JOIN phrases l ON l.lang = p.lang AND l.phrase = array_to_string(string_split(p.phrase, ' ')[:k], ' ')
  JOIN phrases r ON r.lang = p.lang AND r.phrase = array_to_string(string_split(p.phrase, ' ')[k + 1:], ' ')
  JOIN totals t ON t.lang = p.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM phrases y WHERE y.lang = s.lang AND y.words > s.words AND 100 * y.a >= 100 * s.a
      AND contains(' ' || y.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
