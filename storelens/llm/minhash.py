"""MinHash near-duplicates by a join on signature coordinates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import odd_numbers, shingle_set, small_batches, utf8
from storelens.llm.components import connected_components
from storelens.session import stage

COORDINATES = 128
#: Two sets of similarity 0.75 agree in fewer of 128 coordinates with a chance of about one in a million.
MATCHES = 72
#: Coordinates that are posted for every set, to find the sets that can have a match at all.
FIRST = 64
SIMILARITY = 75
WIDTH = 5
_SCALE, _SHIFT = odd_numbers(COORDINATES, 0xA0761D6478BD642F), odd_numbers(COORDINATES, 0xE7037ED1A0B428DB)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate the upper 32 bits of the smallest of the permuted hashes."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at : at + 1024] * _SCALE[:, None] + _SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(batches):
    for batch in batches:
        sizes, keys, signatures = [], [], []
        for text in utf8(batch.column(1)):
            found = shingle_set(text or b"", WIDTH)
            sizes.append(len(found))
            keys.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
            ["doc_id", "n_shingles", "set_key", "signature"],
        )


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(text or b"", WIDTH).view(np.int64) for text in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _alike(n: str, m: str):
    """The sizes alone allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY


def _shared(classes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """Per set (node, n) the posted values that other sets have as well, the rarest first, if there are ``least``."""
    place = F.posexplode(F.slice("signature", 1, coordinates)).alias("place", "low")
    value = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("node", "n", place).select("node", "n", value.alias("value"))
    times = stage(posted.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1"), "times")
    held = posted.join(times, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("held"))
    return held.filter(F.size("held") >= least)


def _prefixes(classes: DataFrame) -> DataFrame:
    """Postings (value, node, n, weight) that two sets agreeing in ``MATCHES`` coordinates can't both avoid.

    Values that only one set has can't be shared, so most sets are out after their first coordinates.
    Of a set's u shared values, ordered by how often they occur, the u - MATCHES + 1 rarest suffice:
    two sets that share MATCHES values share one of them. So values of passages that very many
    documents have are hardly ever posted. weight is how often all of a set's values occur.
    """
    able = stage(_shared(classes, FIRST, MATCHES - COORDINATES + FIRST).select("node").distinct(), "able")
    held = _shared(classes.join(able, "node", "left_semi"), COORDINATES, MATCHES)
    rare = F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1))
    weight = F.aggregate("held.times", F.lit(0).cast("long"), lambda x, y: x + y)
    return held.select("node", "n", weight.alias("weight"), F.explode(rare).alias("post")).select("post.value", "node", "n", "weight")


def _matched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``MATCHES`` coordinates at least."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    return both.filter(equal >= MATCHES).select("a", "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets of shingles are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.filter(F.col("common") * 100 >= union * SIMILARITY).select("a", "b")


def _bin(size) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(1.1))).cast("int")


def _bounded(met: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes against whole components: (node, n, own, component, head, m, largest) where the component allows a link.

    ``met`` has pairs of components. Of each pair the nodes of the one with fewer posted nodes are taken, and their
    shingles counted that occur anywhere in the other. Nodes that can't be similar enough to a
    member that has at least the size of the smallest are left out, and no member is read for them.
    head is the component's member whose values occur most often, m its size, largest that of the largest member.
    """
    sizes = members.groupBy("label").agg(
        F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("largest"), F.max(F.struct("weight", "node", "n")).alias("head")
    )
    pairs = met.select(F.least("label", "other").alias("p"), F.greatest("label", "other").alias("q")).distinct()
    side = lambda x: sizes.select(F.col("label").alias(x), F.struct("k", F.col("label").alias("l"), "least", "largest", "head").alias(f"{x}_size"))
    pairs = pairs.join(side("p"), "p").join(side("q"), "q").select(
        F.least("p_size", "q_size")["l"].alias("label"), F.greatest("p_size", "q_size").alias("large")
    )
    pairs = pairs.filter("large.k > 1").select(
        "label", F.col("large.l").alias("component"), "large.least", F.col("large.head.node").alias("head"), F.col("large.head.n").alias("m"), "large.largest"
    )
    nodes = stage(pairs.join(members, "label").select("node", "n", "own", "component", "least", "head", "m", "largest"), "against")
    mine = nodes.join(sets, "node").select("node", "component", F.explode("shingles").alias("shingle"))
    held = members.join(nodes.select(F.col("component").alias("label")).distinct(), "label", "left_semi").join(sets, "node")
    held = held.select(F.col("label").alias("component"), F.explode("shingles").alias("shingle")).distinct()
    most = mine.join(held, ["component", "shingle"]).groupBy("node", "component").agg(F.count("*").alias("most"))
    able = F.col("most") * 100 >= (F.col("n") + F.greatest("least", "most") - F.col("most")) * SIMILARITY
    return nodes.join(most, ["node", "component"]).filter(able).select("node", "n", "own", "component", "head", "m", "largest")


def _differing(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node, head, ..) with the shingles that the node has and the head lacks (more), the reverse (gone), and how many both are."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = rows.join(side("node"), "node").join(side("head"), "head")
    both = both.withColumn("more", F.array_except("s_node", "s_head")).withColumn("gone", F.array_except("s_head", "s_node"))
    return both.drop("s_node", "s_head").withColumn("differ", F.size("more") + F.size("gone"))


def _places(rows: DataFrame) -> DataFrame:
    flagged = lambda name, extra: F.transform(name, lambda x: F.struct(x.alias("place"), F.lit(extra).alias("extra")))
    return rows.select("group", "node", F.explode(F.concat(flagged("more", 1), flagged("gone", 0))).alias("at")).select("group", "node", "at.*")


def _rarest(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Per row the differences (place) that two sets with ``need`` of them in common can't both avoid.

    Of a set's differences, ordered by how many pairs each makes, all but the need - 1 last suffice. Those without a
    pair come first and need no posting. extra and lost count the others that are in the set and in the head.
    """
    shared = _places(rows).join(times, ["group", "place"]).groupBy("group", "node").agg(
        F.sort_array(F.collect_list(F.struct("times", "place"))).alias("shared"), F.sum("extra").alias("extra"), F.sum(1 - F.col("extra")).alias("lost")
    )
    first = F.size("shared") - F.col("need") + 1
    near = rows.join(shared, ["group", "node"]).filter(first > 0)
    post = F.explode(F.slice("shared", F.lit(1), first)).alias("post")
    return stage(near.select("group", "node", "n", "own", "differ", "extra", "lost", post).select("*", "post.place").drop("post"), "rare")


def _together(one: DataFrame, other: DataFrame, *more: Column) -> DataFrame:
    """Pairs (a, b) of postings of one group that share a place and may be similar enough.

    Sets of a and b shingles that differ from a head in D and E of them, of which they have c in common, differ in
    D + E - 2 c, and are similar enough if 7 (D + E - 2 c) <= a + b. Of shingles that only they have and of those that only the
    head has they share at most what the one with fewer of them has. A set shares n - own shingles with any other at most.
    """
    left = one.select(*[F.col(x).alias(f"{x}_a") for x in ("group", "place", "node", "n", "own", "differ", "extra", "lost")])
    common = F.least("extra", "extra_a") + F.least("lost", "lost_a")
    apart = (F.col("differ") + F.col("differ_a") - common * 2) * 7 <= F.col("n") + F.col("n_a")
    most = F.least(F.col("n") - F.col("own"), F.col("n_a") - F.col("own_a"))
    able = apart & (most * 100 >= (F.col("n") + F.col("n_a") - most) * SIMILARITY)
    same = (F.col("group_a") == F.col("group")) & (F.col("place_a") == F.col("place"))
    return left.join(other, [same & able, *more]).select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()


def _need() -> Column:
    """Least differences from the head that a row's set must share with a set that is not similar to the head."""
    return F.floor((F.col("differ") * 7 + F.col("m") - F.col("n")) / 14) + 1


def _apart(held: DataFrame, heads: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that may be similar enough though neither is to the head of a list that both are in.

    Sets of a and b shingles that differ in d are similar enough if 7 d <= a + b. Two sets that differ from a head of h
    shingles in D and E of them, of which they have c in common, differ in D + E - 2 c. As neither is similar to the head,
    7 E > b + h, so they need 14 c > 7 D + h - a: far copies of a text are only a pair if they were changed in the same
    places. What one copy has alone and what many of them lack makes no pairs (see ``_rarest``).
    """
    near = held.join(heads.select("value", F.col("b").alias("head"), "m"), "value").filter(F.col("node") != F.col("head"))
    near = near.select(F.col("head").alias("group"), "head", "m", "node", "n", "own").distinct()
    rows = _differing(near, sets).withColumn("need", _need())
    rows = stage(rows.filter(F.col("differ") - F.col("own") >= F.col("need")), "apart")
    times = _places(rows).groupBy("group", "place").agg(F.count("*").alias("times")).filter("times > 1")
    rare = _rarest(rows, times)
    return _together(rare, rare, F.struct("n_a", "node_a") < F.struct("n", "node"))


def _against(bounded: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes and members of the components they are held against that may be similar enough.

    Each node meets its component's head. If that is similar, the node is joined to the component and needs no other
    member. If not, what ``_apart`` says of the head holds for every member: it needs 14 c > 7 D + h - a of its D
    differences in common with the node, so most members of a group around the head, which have few differences or
    most of them alone, meet no such node. A node that differs in E shares c >= E - (a + b) / 7 of them.
    """
    nodes = _differing(bounded.withColumnRenamed("component", "group"), sets)
    alike = F.col("differ") * 7 <= F.col("n") + F.col("m")
    nodes = stage(nodes.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("differ") * 7 - F.col("n") - F.col("largest")) / 7))), "apart")
    far = nodes.filter(~alike)
    groups = far.select("group", "head", "m").distinct()
    rows = _differing(members.withColumnRenamed("label", "group").join(groups, "group").filter("node <> head"), sets).withColumn("need", _need())
    rows = stage(rows.filter(F.col("differ") - F.col("own") >= F.col("need")), "apart")
    count = lambda of, name: _places(of).groupBy("group", "place").agg(F.count("*").alias(name))
    times = count(far, "x").join(count(rows, "y"), ["group", "place"]).select("group", "place", (F.col("x") * F.col("y")).alias("times"))
    times = stage(times, "times")
    return nodes.filter(alike).select(F.col("node").alias("a"), F.col("head").alias("b")).union(_together(_rarest(far, times), _rarest(rows, times)))


def _across(posts: DataFrame, heads: DataFrame, alone: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in one posting list that lie in different components and may be similar enough.

    A set of n shingles of which ``own`` occur in no other posted set shares n - own with another of m at
    most, so m + own belong to the union. As the smaller of two it needs n - own >= 0.75 (n + own); as
    the larger, m <= (n - own) / 0.75 - own. Few sets of a passage that many documents share, or of far
    edited copies, meet this, so they are not paired. What remains is paired by component first; a node is then
    held against all shingles of the other component at once (see ``_bounded``), and only where that allows
    it against its head and the members that may be nearer (see ``_against``), so a large component of copies is not read
    once for each of many far copies.
    Components of one posted node each are paired by what sets them apart from a head of theirs (see ``_apart``).
    """
    held = posts.join(alone, "node", "left").join(labels, "node", "left").select(
        "value", "node", "n", "weight", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("component", "node").alias("label")
    )
    n, own = F.col("n"), F.col("own")
    held = stage(held.filter((n - own) * 100 >= n * SIMILARITY), "held")
    small = held.filter((n - own) * 100 >= (n + own) * SIMILARITY).withColumn("bin", _bin("n"))
    low = F.ceil(n * SIMILARITY / 100)
    high = F.least(n, F.floor(((n - own) * 100 - own * SIMILARITY) / SIMILARITY))
    large = held.filter(high >= low).withColumn("bin", F.explode(F.sequence(_bin(low), _bin(high))))
    entries = small.select("value", "bin", "label").distinct()
    others = large.select("value", "bin", F.col("label").alias("other")).distinct()
    members = stage(held.select("label", "node", "n", "own", "weight").distinct(), "members")
    single = members.groupBy("label").agg(F.count("*").alias("k")).filter("k = 1").select("label")
    others_single = single.withColumnRenamed("label", "other")
    met = entries.join(single, "label", "left_anti").join(others, ["value", "bin"])
    more = entries.join(single, "label", "left_semi").join(others.join(others_single, "other", "left_anti"), ["value", "bin"])
    met = stage(met.unionByName(more).filter(F.col("label") != F.col("other")), "met")
    bounded = stage(_bounded(met, members, sets), "bounded")
    return _apart(held.join(single, "label", "left_semi"), heads, sets).union(_against(bounded, members, sets)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the size of its set of 5-word shingles and its component of near-duplicates.

    Returns (doc_id, n_shingles, component_id, kept). Sets with 100 * intersection >= 75 * union are
    linked, component_id is the smallest doc_id that links reach, kept marks the document itself.

    1. Equal sets become one class with its smallest doc_id as node, so copies cost one signature.
    2. Signature coordinates are posted (see ``_prefixes``). Each node is checked against one node of each
       of its posting lists only: the one whose values occur most often, near the middle of a group.
    3. What the confirmed links join already needs no further check. Only nodes of one posting list
       that are still in different components are paired (see ``_across``), so neither a large group of
       copies, near or far, nor a passage that many documents share makes many pairs.
    4. Pairs that agree in ``MATCHES`` coordinates are confirmed on their full sets, read from the texts.

    Null, empty and blank texts have n_shingles 0 and are linked with nothing. A null doc_id gets
    a null component and is not kept. Rows that repeat a doc_id each get a row; with other texts they share
    their links. Other columns are ignored.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(docs.mapInArrow(_signed, "doc_id long, n_shingles long, set_key binary, signature array<int>"), "signed")
    classes = stage(
        signed.filter("set_key is not null and doc_id is not null")
        .groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )
    posts = stage(_prefixes(classes), "posts")

    nodes = posts.select("node").distinct()
    texts = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi")
    sets = stage(texts.mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    once = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("times"))
    alone = stage(once.filter("times = 1").groupBy("node").agg(F.count("*").alias("own")), "alone")

    heads = stage(
        posts.groupBy("value").agg(F.max(F.struct("weight", "node", "n")).alias("head"), F.count("*").alias("times")).filter("times > 1")
        .select("value", F.col("head.node").alias("b"), F.col("head.n").alias("m")), "heads",
    )
    met = posts.join(heads, "value").filter(F.col("node") != F.col("b")).filter(_alike("n", "m"))
    first = stage(_matched(stage(met.select(F.col("node").alias("a"), "b").distinct(), "met"), classes), "pairs")
    links = stage(_linked(first, sets), "links")

    labels = stage(connected_components(links), "labels")
    second = stage(_matched(stage(_across(posts, heads, alone, labels, sets), "across"), classes), "pairs")
    links = stage(links.union(_linked(second, sets)), "links")

    labels = stage(connected_components(links), "labels")
    found = stage(
        classes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id")), "found"
    )
    own = F.coalesce("component_id", "doc_id")
    return signed.join(found, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document per component, with all their columns.

    Of rows that repeat a kept doc_id those with different texts all stay, repeated ones of one text once.
    Rows without a doc_id can't be told apart and all stay.
    """
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(id_col)).distinct()
    one = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return one.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
