"""Operator 7: embedding near-duplicates with collision-counting projections.

Unit vectors at the threshold have a known distance, so a one-dimensional Gaussian projection separates them by a
known normal law. Each of several lists sorts the vectors by such projections: all but one
are cut into cells, the last orders a cell; a pair collides in a list if it shares the cell and lies
in the query-centred window of the last projection. Collisions are counted over all lists, and pairs with
the calibrated count are verified by their exact cosine. Lists and count come from the wanted recall.

In a list, vectors meet by cell and are cut by their last projection into blocks of bounded size, each with the window
before it; in a block one side is sorted and each vector takes the stretch of its window. A pair that collides in several lists is
counted in the first of them alone, which both vectors' projections tell. So a block gives the links per vector and, for
components, a spanning forest of its links; no pair is emitted.

Vectors are compared with those of their own length, one length after the other.

Cases: null vectors, vectors of zero, or with null or non-finite components link with nothing and are their
own component; equal vectors are one vector with copies, linked
with each other; ties in a list don't matter; repeated rows are vectors of their own; null vec_ids count
only in classes without any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh_key, scratch, spread, staged

THRESHOLD, RECALL, WANTED_COUNT = 0.95, 0.995, 2
#: Cell width and window in units of the threshold's distance; projections that are cut into cells, per list.
WIDTH, WINDOW, CELLS = 3.0, 2.6, 5
BLOCK = 1024


def same_cell(width: float) -> float:
    """Chance that two values a standard normal step apart (times 1 / width cells) share a randomly shifted cell."""
    normal = NormalDist()
    return 1 - 2 * normal.cdf(-width) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def lists_needed(recall: float = RECALL, count: int = WANTED_COUNT) -> int:
    """Lists after which a pair at the threshold has ``count`` collisions with the wanted recall."""
    p = same_cell(WIDTH) ** CELLS * (2 * NormalDist().cdf(WINDOW) - 1)
    for lists in range(count, 10_000):
        miss = sum(math.comb(lists, k) * p**k * (1 - p) ** (lists - k) for k in range(count))
        if 1 - miss >= recall:
            return lists
    raise ValueError("no number of lists reaches this recall")


class Lists:
    """The random projections of all lists for vectors of one length."""

    def __init__(self, dim: int, threshold: float, lists: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.distance = math.sqrt(2 - 2 * threshold)
        self.directions = rng.standard_normal((dim, lists * (CELLS + 1)))
        self.shift = rng.random(lists * (CELLS + 1))
        self.odd = rng.integers(0, 2**63, size=(CELLS,), dtype=np.uint64) | np.uint64(1)
        self.lists = lists

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (n x lists) and value in it (n x lists) of each unit vector."""
        values = (vectors @ self.directions).reshape(len(vectors), self.lists, CELLS + 1)
        cells = np.floor(values[..., :CELLS] / (WIDTH * self.distance) + self.shift.reshape(self.lists, CELLS + 1)[:, :CELLS]).astype(np.int64)
        mixed = np.zeros(cells.shape[:2], np.uint64)
        for k in range(CELLS):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.uint64) * self.odd[k]
        return mixed.view(np.int64), values[..., CELLS]


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def window_pairs(cells: np.ndarray, values: np.ndarray, cells2: np.ndarray, values2: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of both sides with equal cells and values at most about ``window`` apart: one side is sorted by (cell, value), and each of the other
    takes the stretch of its window."""
    names = np.unique(np.concatenate([cells, cells2]), return_inverse=True)[1]
    low = min(values.min(initial=0.0), values2.min(initial=0.0))
    span = max(values.max(initial=0.0), values2.max(initial=0.0)) - low + 4 * window + 1
    keys, keys2 = names[: len(cells)] * span + (values - low), names[len(cells) :] * span + (values2 - low)
    order = np.argsort(keys2)
    starts, ends = (np.searchsorted(keys2[order], keys + side * (window + 1e-9), how) for side, how in ((-1, "left"), (1, "right")))
    n = ends - starts
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(keys)), n), order[np.repeat(starts, n) + within]


def block_links(own: np.ndarray, own_ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, at: int, lists: Lists, threshold: float, count: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of own, rows of other) that first collide in list ``at``, collide often enough and reach the threshold."""
    window = WINDOW * lists.distance
    cells, values = lists.place(own)
    cells2, values2 = lists.place(other)
    i, j = window_pairs(cells[:, at], values[:, at], cells2[:, at], values2[:, at], window)
    if same:
        i, j = i[i < j], j[i < j]
    out_i, out_j = [], []
    for low in range(0, len(i), 100_000):
        a, b = i[low : low + 100_000], j[low : low + 100_000]
        hit = (cells[a] == cells2[b]) & (np.abs(values[a] - values2[b]) <= window)
        good = hit[:, at] & (hit.sum(1) >= count) & ~hit[:, :at].any(1)
        a, b = a[good], b[good]
        good = np.einsum("ij,ij->i", own[a], other[b]) >= threshold
        out_i.append(a[good])
        out_j.append(b[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges, by union of their ends."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64)


def vector_links(vectors: DataFrame, dim: int, threshold: float = THRESHOLD, recall: float = RECALL, count: int = WANTED_COUNT) -> DataFrame:
    """(vec, unit array<double>) of distinct vectors -> rows (a, b, n): a has n links more; b, where not null, is a spanning link of a.

    ``n`` weighs each partner by its column ``copies``.
    """
    n_lists = lists_needed(recall, count)
    lists = Lists(dim, threshold, n_lists)
    shared = vectors.sparkSession.sparkContext.broadcast(lists)

    def place(batches):
        for pdf in batches:
            cells, values = shared.value.place(np.stack(pdf["unit"].to_numpy()))
            yield pd.DataFrame({"vec": np.repeat(pdf["vec"].to_numpy(), n_lists), "list": np.tile(np.arange(n_lists, dtype=np.int32), len(pdf)), "cell": cells.ravel(), "value": values.ravel()})

    placed = staged(vectors.select("vec", "unit").mapInPandas(place, "vec long, list int, cell long, value double"), "embed-places")
    # cells with one vector have no pair; the others are sorted and cut into blocks
    sizes = placed.groupBy("list", "cell").agg(F.count("*").alias("m"), F.min("value").alias("low"), F.max("value").alias("high")).where("m > 1")
    # a block is a slice of a cell's value range with about BLOCK vectors; pairs reach over a window into later slices
    slices = F.greatest(F.lit(1), F.least(F.ceil(F.col("m") / BLOCK), F.floor((F.col("high") - F.col("low")) / (WINDOW * lists.distance)))).cast("int")
    sizes = sizes.withColumn("slices", slices).select(F.xxhash64("list", "cell").alias("k_"), "m", "low", "high", "slices")
    cut = placed.withColumn("k_", F.xxhash64("list", "cell")).join(sizes, "k_").drop("k_")
    cut = cut.withColumn("slice", F.least(F.col("slices") - 1, F.floor((F.col("value") - F.col("low")) / F.greatest(F.lit(1e-12), F.col("high") - F.col("low")) * F.col("slices"))).cast("int"))
    # very many vectors in one window: both sides are dealt into parts, and each pair of parts is a block of its own
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / F.col("slices") / BLOCK)).cast("int")
    cut = cut.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vec", F.lit(1)), F.col("parts")).cast("int"))
    # own: to the blocks (slice, part, q >= part); other: to the same and, as the later side, to the slice before
    near = F.expr("transform(sequence(0, parts - 1), q -> struct(slice as slice, least(part, q) as p, greatest(part, q) as q, 0 as ahead))")
    far = F.expr("if(slice > 0, transform(sequence(0, parts - 1), q -> struct(slice - 1 as slice, q as p, part as q, 1 as ahead)), array())")
    back = F.expr("if(slice < slices - 1, transform(sequence(0, parts - 1), q -> struct(slice as slice, part as p, q as q, 2 as ahead)), array())")
    whole = (F.col("slices") * F.col("parts") == 1).alias("whole")
    dealt = cut.select("vec", "list", "cell", "part", whole, F.explode(F.concat(near, far, back)).alias("s")).select("vec", "list", "cell", "part", "whole", "s.*")
    # cells of a single block share blocks: as many as hold about BLOCK of the vectors
    shared_blocks = spread(vectors.count(), BLOCK)
    block = F.when(F.col("whole"), F.xxhash64("list", F.pmod(F.xxhash64("cell"), F.lit(shared_blocks)))).otherwise(F.xxhash64("list", "cell", "slice", "p", "q", F.col("ahead") > 0))
    dealt = dealt.select("vec", "list", "part", "p", "q", "ahead", block.alias("block"))
    full = dealt.withColumn("k_", fresh_key("vec")).join(vectors.select(fresh_key("vec").alias("k_"), "unit", "copies"), "k_").drop("k_")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        at, first = int(pdf["list"].iloc[0]), pdf.iloc[0]
        units, ids, copies = np.stack(pdf["unit"].to_numpy()), pdf["vec"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        if first["ahead"] > 0:
            left, right, same = np.flatnonzero(pdf["ahead"] == 2), np.flatnonzero(pdf["ahead"] == 1), False
        elif first["p"] == first["q"]:
            left = right = np.arange(len(pdf))
            same = True
        else:
            left, right, same = np.flatnonzero(pdf["part"] == first["p"]), np.flatnonzero(pdf["part"] == first["q"]), False
        i, j = block_links(units[left], ids[left], units[right], ids[right], at, shared.value, threshold, count, same)
        i, j = left[i], right[j]
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(n)
        a, b = forest(ids[i], ids[j])
        return pd.concat([pd.DataFrame({"a": ids[some], "b": pd.array([pd.NA] * len(some), "Int64"), "n": n[some].astype(np.int64)}), pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "n": np.zeros(len(a), np.int64)})])

    return full.groupBy("block").applyInPandas(links, "a long, b long, n long")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    with scratch() as keep:
        return keep(_near_vectors(rows, threshold, recall), "embed-result")


def _near_vectors(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    vector = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v_", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v_", F.lit(0.0), lambda s, x: s + x * x))
    base = rows.select("vec_id", vector.alias("v_")).withColumn("norm_", F.when(F.col("v_").isNotNull() & ~F.coalesce(bad, F.lit(True)), norm))
    base = base.withColumn("vec", F.when(F.col("norm_") > 0, F.xxhash64(F.to_json("v_"))))
    base = staged(base.withColumn("row_", F.monotonically_increasing_id()), "embed-rows")
    unit = F.transform("v_", lambda x: x / F.col("norm_"))
    distinct = base.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first(unit).alias("unit"))
    distinct = staged(distinct, "embed-distinct")
    dims = sorted(r.dim for r in distinct.groupBy(F.size("unit").alias("dim")).count().where("count > 1").collect())  # one row per length
    links = [vector_links(distinct.where(F.size("unit") == dim), dim, threshold, recall) for dim in dims or [1]]
    found = staged(reduce(DataFrame.union, links), "embed-links")
    more = found.groupBy(F.col("a").alias("vec")).agg(F.sum("n").alias("others"))
    components = staged(connected_components(found.where("b is not null").select("a", "b")), "embed-components")
    of = distinct.select("vec", "vec_id", "copies").join(more, "vec", "left").join(components.withColumnRenamed("node", "vec"), "vec", "left")
    of = staged(of.select("vec", "vec_id", F.coalesce("component", "vec").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "embed-of")
    least = of.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of = of.withColumn("k_", fresh_key("component")).join(least.select(fresh_key("component").alias("k_"), "component_id"), "k_")
    out = base.select("vec_id", F.coalesce(fresh_key("vec"), F.xxhash64("row_", F.lit("alone"))).alias("k_"))
    out = out.join(of.select(fresh_key("vec").alias("k_"), "component_id", "n_links"), "k_", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
