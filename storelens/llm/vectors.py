"""Near-duplicate vectors by products of int8 tiles with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import small_batches
from storelens.llm.components import connected_components
from storelens.session import stage

COSINE = 0.93
#: Vectors of a tile on average; two tiles, their products and flags are what a task holds at a time.
TILE_ROWS = 1024


def quantize(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and the lengths of what quantisation left out, per row of unit vectors."""
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    return codes, scales, np.linalg.norm(units - codes * scales[:, None], axis=1)


def linked(left: np.ndarray, right: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers of the pairs with cosine >= ``cosine``, and how many needed full precision.

    A unit vector is x = q + e with q its dequantised codes. By Cauchy-Schwarz the product of two,
    x . y = q . p + q . f + e . y, differs from q . p by |q| |f| + |e| at most, and |q| <= 1 + |e|.
    Pairs whose bound reaches the threshold are computed again in double precision from the vectors.
    """
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (left, right)]
    (a, sa, ea), (b, sb, eb) = map(quantize, unit)
    # Whole numbers below 2^24 are exact in float32, for up to 1,000 dimensions of products of two int8.
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    product = (a.astype(kind) @ b.astype(kind).T) * sa[:, None] * sb[None, :]
    bound = product + (1 + ea)[:, None] * eb[None, :] + ea[:, None] + 1e-5
    i, j = np.nonzero(bound >= cosine)
    # In the contract's own form: dot product over the product of the norms.
    keep = np.zeros(len(i), bool)
    norms = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = np.einsum("ij,ij->i", left[x], right[y]) / (norms[0][x] * norms[1][y]) >= cosine
    return i[keep], j[keep], len(i)


def _spanning(i: np.ndarray, j: np.ndarray, nodes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Edges that join what the links join, at most one per node."""
    parent = list(range(size))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            out.append((int(nodes[x]), int(nodes[y])))
    return out


def _tile_pair(cosine: float):
    def run(key, table):
        first, second = key[2].as_py(), key[3].as_py()
        tile = table.column("tile").to_numpy()
        nodes, many = table.column("node").to_numpy(), table.column("many").to_numpy()
        values = np.stack([np.asarray(v.values, np.float64) for v in table.column("embedding").combine_chunks()])
        x, y = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        none = pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not len(x) or not len(y):
            return none
        links, found = np.zeros(len(nodes), np.int64), []
        for at in range(0, len(x), TILE_ROWS):
            rows = x[at : at + TILE_ROWS]
            for to in range(0, len(y), TILE_ROWS):
                columns = y[to : to + TILE_ROWS]
                i, j, _ = linked(values[rows], values[columns], cosine)
                i, j = rows[i], columns[j]
                if first == second:
                    i, j = i[i != j], j[i != j]
                np.add.at(links, i, many[j])
                if first != second:
                    np.add.at(links, j, many[i])
                found += _spanning(i, j, np.arange(len(nodes)), len(nodes))
        i, j = np.array([p for p, _ in found], np.int64), np.array([q for _, q in found], np.int64)
        edges = _spanning(i, j, nodes, len(nodes))
        own = np.flatnonzero(links)
        return pa.table({
            "node": pa.array([*nodes[own], *(p for p, _ in edges)], pa.int64()), "other": pa.array([*[None] * len(own), *(q for _, q in edges)], pa.int64()),
            "links": pa.array([*links[own], *[0] * len(edges)], pa.int64()),
        })

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tile_rows: int = TILE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of vectors of equal label with a cosine of ``cosine`` or more: (vec_id, n_links, component_id, kept).

    n_links counts the other vectors linked directly, component_id is the smallest vec_id that links
    reach, kept marks the vector that has it.

    Equal vectors of a label become one class that counts for all of them. Classes are dealt to tiles of
    about ``tile_rows``, and each pair of tiles of one label is a task of its own: int8 products bound the
    cosines, and only pairs that may reach the threshold are computed in double precision. A task
    returns link counts and a spanning forest, never the pairs, so a dense group stays small.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
    have no links and are their own component, as are vectors of different lengths to each other. Rows that
    repeat a vec_id are vectors of their own; a null vec_id takes part in no link, gets a null component
    and is not kept. Other columns are ignored.
    """
    held = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(finite & some & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # -0.0 and 0.0 are one value.
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v).cast("double"))
    held = held.select("vec_id", "label", plain.alias("embedding"), good.alias("good"))
    keyed = F.concat_ws(":", F.col("label").cast("string"), F.xxhash64("embedding"), F.xxhash64(F.lit(7), "embedding"))
    held = stage(held.select("vec_id", "label", "embedding", F.when(F.col("good"), keyed).alias("key")), "vectors")
    classes = held.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    ).withColumn("node", F.xxhash64("key")).withColumn("size", F.size("embedding"))
    classes = stage(classes, "classes")
    tiles = F.ceil(F.col("n") / tile_rows).cast("int")
    many = stage(classes.groupBy("label", "size").agg(F.count("*").alias("n")).select("label", "size", tiles.alias("tiles")), "tiles")
    dealt = classes.join(many, ["label", "size"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "size", F.least("tile", "with").alias("first"), F.greatest("tile", "with").alias("second"), "tile", "node", "many", "embedding"
    )
    small_batches(paired)
    found = paired.groupBy("label", "size", "first", "second").applyInArrow(_tile_pair(cosine), "node long, other long, links long")
    found = stage(found, "found")
    labels = stage(connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), "labels")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.select("key", "node", "many", "least").join(counted, "node", "left").join(labels, "node", "left")
    by_class = stage(by_class.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "node").alias("group")), "by_class")
    firsts = stage(by_class.groupBy("group").agg(F.min("least").alias("component")), "firsts")
    by_class = stage(by_class.select("key", "links", "group").join(firsts, "group"), "by_class")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return held.select("vec_id", "key").join(by_class, "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
