"""Benchmark decontamination: SimHash windows, blocks of their bits, exact shingle similarity. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.session import stage

WIDTH = 5
SIMILARITY = 75
#: Fingerprints that differ in at most so many of 64 bits are candidates; one of RADIUS + 1 blocks of bits is then equal.
RADIUS = 3
BLOCK_BITS = 64 // (RADIUS + 1)
#: Windows by the items' words: items from ``least`` to ``most`` words are found by windows of ``size`` words, in
#: documents at every ``step``-th word, in items at every word. An item-sized passage of similarity 0.75 loses
#: at most a seventh of the item's shingles, and each edit inside it four or five, so it has an unedited run
#: of size + step - 1 words.
WINDOWS = ((15, None, 7, 8), (10, 14, 7, 4), (5, 9, 3, 3))
#: Index rows (of about 50 bytes) up to which the index of the items is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _majority(a: Column, b: Column, c: Column) -> Column:
    return a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b)))


def _odd(a: Column, b: Column, c: Column) -> Column:
    return a.bitwiseXOR(b).bitwiseXOR(c)


def simhash(h: list[Column]) -> Column:
    """Fingerprint of 3 or 7 word hashes: per bit, what most of them have.

    Adders count all 64 bits at once: of seven, three sums of three give the twos, and two twos are most.
    """
    if len(h) == 3:
        return _majority(*h)
    if len(h) == 7:
        x, y = _odd(*h[:3]), _odd(*h[3:6])
        return _majority(_majority(*h[:3]), _majority(*h[3:6]), _majority(x, y, h[6]))
    raise ValueError("windows have 3 or 7 words")


def _windows(held: DataFrame, size: int, step: int, *kept: str) -> DataFrame:
    """Fingerprints of the windows of ``size`` words that start at every ``step``-th word (column ``at``)."""
    last = F.size("hashes") - size
    at = held.select(*kept, "hashes", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))).alias("at"))
    return at.select(*kept, "at", simhash([F.get("hashes", F.col("at") + i) for i in range(size)]).alias("print"), F.lit(size).alias("kind"))


def _blocks() -> Column:
    """Keys (window size, block, bits of the block) of a fingerprint."""
    low = (1 << BLOCK_BITS) - 1
    return F.array(*[
        F.shiftrightunsigned("print", BLOCK_BITS * b).bitwiseAND(F.lit(low)) + ((F.col("kind") * (RADIUS + 1) + b) * (1 << BLOCK_BITS))
        for b in range(RADIUS + 1)
    ])


def _first_equal(apart: Column) -> Column:
    """Whether the block that two fingerprints met by is the first that they share, so that each pair is met once."""
    low = (1 << BLOCK_BITS) - 1
    block = F.shiftright("block", BLOCK_BITS) % (RADIUS + 1)
    differ = [F.shiftrightunsigned(apart, BLOCK_BITS * b).bitwiseAND(F.lit(low)) != 0 for b in range(RADIUS)]
    return reduce(Column.__and__, [(block <= b) | d for b, d in enumerate(differ)])


def _hashed(held: DataFrame) -> DataFrame:
    return held.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _counted(windows: DataFrame, *key: str) -> DataFrame:
    """Times that each 5-word shingle occurs among ``words``, and how many there are."""
    many = F.size("words") - WIDTH + 1
    starts = F.sequence(F.lit(1), F.greatest(many, F.lit(1)))
    each = windows.select(*key, "words", F.greatest(many, F.lit(1)).alias("total"), F.explode(starts).alias("i"))
    shingled = each.select(*key, "total", F.array_join(F.slice("words", F.col("i"), F.lit(WIDTH)), " ").alias("shingle"))
    return shingled.groupBy(*key, "total", "shingle").agg(F.count("*").alias("times"))


def _best_starts(near: DataFrame, pair: tuple[str, ...], last: Column) -> DataFrame:
    """The window starts with enough shingles in common, from the places of an item's shingles in a document.

    A place counts for the windows that hold it and, of the same shingle, fewer places before it than the
    item has. These starts are a range, so the number in common is a running sum over the ranges' ends.
    """
    total, item_total = F.least("n", "length") - WIDTH + 1, F.col("n") - WIDTH + 1
    places = near.filter("shingle_id is not null").groupBy(*pair, "n", "length", "shingle_id", "times").agg(F.sort_array(F.collect_list("p")).alias("places"))
    ranges = F.transform("places", lambda p, i: F.struct(
        F.greatest(F.get("places", (i - F.col("times")).cast("int")) + 1, p - total + 1, F.lit(0)).alias("low"), F.least(p, last).alias("high")
    ))
    ends = places.select(*pair, "n", "length", F.inline(ranges)).filter("low <= high")
    ends = ends.select(*pair, "n", "length", F.inline(F.array(
        F.struct(F.col("low").alias("start"), F.lit(1).alias("more")), F.struct((F.col("high") + 1).alias("start"), F.lit(-1).alias("more"))
    ))).withColumn("aligned", F.lit(False))
    aligned = near.filter("aligned").select(*pair, "n", "length", F.col("p").alias("start"), F.lit(0).alias("more"), "aligned")
    steps = ends.unionByName(aligned).groupBy(*pair, "n", "length", "start").agg(F.sum("more").alias("more"), F.max("aligned").alias("aligned"))
    summed = steps.withColumn("common", F.sum("more").over(Window.partitionBy(*pair).orderBy("start")))
    union = total + item_total - F.col("common")
    close = summed.filter((F.col("start") <= last) & (F.col("common") * 100 >= union * SIMILARITY))
    return close.select("doc_id", "item", "start", "aligned", (F.col("common") / union).alias("similarity"))


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id, window_start, similarity), the best window of each pair.

    A document holds an item of n words if one of its windows of n words shares enough 5-word shingles
    with it: weighted by how often they occur, 100 * sum of minima >= 75 * sum of maxima. All windows are
    tried that hold a run of unedited words, so parts of the item may stand in another order.
    window_start is the best window's word number; of equally good ones the first that is aligned with the
    item at such a run, give or take the words that edits may shift, else the first. Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text.

    1. Items and documents get SimHash fingerprints of windows whose size goes by the item's (``WINDOWS``).
    2. The 64 bits are cut into RADIUS + 1 blocks. Fingerprints within the radius share a whole block,
       so a join on blocks finds all of them.
    3. All item-sized windows that hold a candidate are compared exactly.

    Documents shorter than an item are compared whole. Items of fewer than five words are one shingle and
    are found only in documents of just these words. Null, empty and blank texts hold nothing and are held
    by nothing. Items of equal words are searched once and reported each; a null item_id is reported as such.
    A repeated row adds nothing. Documents without a doc_id are not reported. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words")).filter("doc_id is not null")
    named = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("words")).filter("size(words) > 0")
    named = stage(named.select("item_id", F.md5(F.array_join("words", " ")).alias("item"), "words").distinct(), "items")
    items = named.select("item", "words").distinct()
    item_words = F.size("words")

    there = [item_words.between(least, most) if most else item_words >= least for least, most, _, _ in WINDOWS]
    some = items.agg(*[F.coalesce(F.bool_or(x), F.lit(False)) for x in there]).first()
    kinds = [k for k in range(len(WINDOWS)) if some[k]]
    found = docs.filter(item_words < WIDTH).join(items.filter(item_words < WIDTH), "words").select(
        "doc_id", "item", F.lit(0).alias("start"), F.lit(True).alias("aligned"), F.lit(1.0).alias("similarity")
    )
    pair = ("doc_id", "text_key", "item")
    if kinds:
        index, probes = [], []
        hashed = _hashed(docs).withColumn("text_key", F.xxhash64("words"))
        for size in sorted({WINDOWS[k][2] for k in kinds}):
            same = [k for k in kinds if WINDOWS[k][2] == size]
            own = _hashed(items.filter(reduce(Column.__or__, [there[k] for k in same]))).withColumn("n", item_words)
            index.append(_windows(own, size, 1, "item", "n").withColumnsRenamed({"at": "offset", "print": "item_print"}))
            probe = _windows(hashed, size, min(WINDOWS[k][3] for k in same), "doc_id", "text_key", "words")
            probes.append((size, probe.select("doc_id", "text_key", "words", "at", "print", F.explode(_blocks()).alias("block"))))
        index = reduce(DataFrame.unionByName, index).withColumn("print", F.col("item_print"))
        index = stage(index.select("item", "n", "offset", "item_print", F.explode(_blocks()).alias("block")).drop("print"), "index")
        index = _small(index, broadcast_rows)
        theirs = _counted(items, "item").withColumn("shingle_id", F.monotonically_increasing_id())
        theirs = _small(stage(theirs.select("item", "shingle", "times", "shingle_id"), "shingles"), broadcast_rows)
        near = []
        shift = F.floor((F.col("n") - WIDTH + 1) / 28).cast("int")
        last = F.greatest(F.col("length") - F.col("n"), F.lit(0))
        clamped = lambda start: F.greatest(F.least(start, last), F.lit(0))
        for size, probe in probes:
            apart = F.col("print").bitwiseXOR(F.col("item_print"))
            close = probe.join(index, "block").filter((F.bit_count(apart) <= RADIUS) & _first_equal(apart)).withColumn("length", F.size("words"))
            # All words of the windows of n words that hold these ones.
            low = F.greatest(F.col("at") + size - F.col("n") - shift, F.lit(0))
            high = F.least(F.col("length"), F.col("at") + F.col("n")) - WIDTH
            held = close.withColumn("start", F.col("at") - F.col("offset")).select(
                *pair, "n", "length", "words", clamped(F.col("start") - shift).alias("low"), clamped(F.col("start") + shift).alias("high"),
                F.explode(F.when(low <= high, F.sequence(low, high))).alias("p"),
            )
            held = held.select(
                *pair, "n", "length", "p", F.col("p").between(F.col("low"), F.col("high")).alias("aligned"),
                F.array_join(F.slice("words", F.col("p") + 1, WIDTH), " ").alias("shingle"),
            )
            near.append(held.join(theirs, ["item", "shingle"], "left").filter("aligned or shingle_id is not null").drop("shingle"))
        near = reduce(DataFrame.unionByName, near).groupBy(*pair, "n", "length", "p").agg(
            F.max("aligned").alias("aligned"), F.max("times").cast("int").alias("times"), F.max("shingle_id").alias("shingle_id")
        )
        close = _best_starts(stage(near, "near"), pair, last)
        found = found.unionByName(close)
    best = found.groupBy("doc_id", "item").agg(F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("start"))).alias("best"))
    named = _small(named.select("item", "item_id").distinct(), broadcast_rows)
    return best.join(named, "item").select(
        "doc_id", "item_id", (-F.col("best.start")).cast("int").alias("window_start"), F.col("best.similarity").alias("similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; those without a doc_id stay."""
    held = stage(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "held")
    return docs.join(held, id_col, "left_anti").select(*docs.columns)


_SQL_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: The same in SQL: all aligned windows at shared shingles, compared exactly.
SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {_SQL_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, {_SQL_WORDS} AS w FROM benchmark),
ds AS (SELECT doc_id, w, p, list_aggregate(w[p:p+4], 'string_agg', ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
sh AS (SELECT item_id, w, p, list_aggregate(w[p:p+4], 'string_agg', ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
hit AS (SELECT DISTINCT doc_id, item_id, ds.w AS dw, sh.w AS iw, ds.p - sh.p AS a FROM ds JOIN sh USING (s)),
moved AS (SELECT doc_id, item_id, dw, iw, a + unnest(range(-((len(iw) - 4) // 28), (len(iw) - 4) // 28 + 1)) AS a FROM hit),
win AS (SELECT DISTINCT doc_id, item_id, dw, iw, greatest(least(a, greatest(len(dw) - len(iw), 0)), 0) AS a FROM moved),
cut AS (SELECT doc_id, item_id, a, dw[a+1:a+len(iw)] AS x, iw FROM win),
xs AS (SELECT doc_id, item_id, a, s, count(*) AS c FROM (
         SELECT doc_id, item_id, a, list_aggregate(x[p:p+4], 'string_agg', ' ') AS s FROM (
           SELECT *, unnest(range(1, greatest(len(x) - 3, 2))) AS p FROM cut)) GROUP BY ALL),
ys AS (SELECT item_id, s, count(*) AS c, len(any_value(w)) - 4 AS n FROM sh GROUP BY item_id, s),
xn AS (SELECT doc_id, item_id, a, sum(c) AS n FROM xs GROUP BY ALL),
pair AS (SELECT doc_id, item_id, a, xn.n AS n, any_value(ys.n) AS m, sum(least(xs.c, ys.c)) AS k
         FROM xs JOIN ys USING (item_id, s) JOIN xn USING (doc_id, item_id, a) GROUP BY doc_id, item_id, a, xn.n),
good AS (SELECT doc_id, item_id, a, k / (n + m - k) AS sim FROM pair WHERE 100 * k >= 75 * (n + m - k)
         UNION ALL SELECT doc_id, item_id, 0, 1.0 FROM d JOIN i USING (w) WHERE len(w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, CAST(arg_min(a, (-sim, a)) AS INTEGER) AS window_start, CAST(max(sim) AS DOUBLE) AS similarity
FROM good GROUP BY doc_id, item_id
"""
