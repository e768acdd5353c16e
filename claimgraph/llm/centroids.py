"""Operator 13: centroid clustering (Lloyd's rounds in whole numbers) over space-filling-curve zone maps.

Vectors are ordered along a Hilbert curve and cut into blocks of consecutive ones, each with its box of least and
greatest components. In a round the distances between a block's box and the centroids bound those of all its vectors, so
a centroid whose least distance exceeds another's greatest is no candidate of the block. Blocks with one candidate
add their stored sums; the others compare their vectors with the candidates alone, exactly and vectorised.
Bounds are in whole numbers too, so nothing depends on the order of vectors or on the number of tasks.

Between rounds only the centroids' sums (``k`` rows) come to the driver. The curve's ranges are cut by (key, hash of the
row), so that copies of one vector spread over tasks.

Cases: vectors that are null, of another length, or that hold null or non-finite components take no part and have no
row, and neither have those with components beyond 2^17 in size, whose squared distances would not fit a long. Ties go to
the centroid with the smaller number. With fewer than ``k`` vectors each starts a centroid; equal starts are allowed (the
later one stays empty). Null vec_ids start last; rows with equal vec_ids start in the order of their vectors. Repeated rows are vectors of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

DIM, SCALE, K, ROUNDS = 64, 1024, 8, 10
#: Vectors of a block, bits of the curve for each component, and the largest component.
BLOCK, BITS, MOST = 512, 4, 1 << 17


def whole_vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>): floor(scale * component) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fits = F.forall("x_", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x_")).where((F.size("x_") == dim) & fits)
    return good.select("vec_id", F.transform("x_", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``3:<vec_id>``, in that order: a top-k, ``k`` rows come to the driver."""
    order = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    least = vectors.select(order.alias("h_"), "v").orderBy(F.asc_nulls_last("h_"), "v").limit(k).collect()
    return np.array([r.v for r in least], np.int64)


def bounds(vectors: DataFrame, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every component, in one row."""
    at = [F.get("v", d) for d in range(dim)]
    row = vectors.agg(F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high")).first()
    return np.array(row.low, np.int64), np.array(row.high, np.int64)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each row of ``cells`` (n x dim, values below 2^bits) on the Hilbert curve, as big-endian bytes (Skilling, 2004)."""
    x = cells.astype(np.uint32).T.copy()
    dim, n = x.shape
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the rotations, from the top bit down
        p = np.uint32(q - 1)
        for d in range(dim):
            up = (x[d] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & p).astype(np.uint32)
            x[0] ^= np.where(up, p, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dim):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros(n, np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dim - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = np.stack([(x[d] >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1) for d in range(dim)], 1).astype(np.uint8)
    packed = np.packbits(planes, axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)


def ordered(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v) in the order of the curve: ranges over all executors, sorted inside."""
    low, high = bounds(vectors, dim)
    step = np.maximum(1, -(-(high - low + 1) // (1 << BITS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hilbert_keys((_matrix(batch.column(1), dim) - low) // step) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["vec_id", "v", "row_", "curve_"])

    # copies of one vector have one place: the row's hash tells them apart, so that they spread over ranges
    rows = vectors.withColumn("row_", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    placed = rows.mapInArrow(place, "vec_id long, v array<int>, row_ long, curve_ binary")
    return placed.repartitionByRange("curve_", "row_").sortWithinPartitions("curve_", "row_").select("vec_id", "v")


def zone_blocks(vectors: DataFrame, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """Blocks of consecutive vectors: ids, packed vectors, and the zone map (rows, low, high, sums), staged."""
    names = ["n", "low", "high", "sums", "ids", "packed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def blocks(table: pa.Table, all_: bool) -> Iterator[pa.RecordBatch]:
            for at in range(0, table.num_rows if all_ else table.num_rows // block * block, block):
                part = table.slice(at, block).combine_chunks()
                ids, v = part.column(0).combine_chunks(), part.column(1).combine_chunks()
                m = _matrix(v, dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(m)], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (m.min(0), m.max(0), m.sum(0))), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([m.astype(np.int32).tobytes()], pa.binary())],
                    names,
                )

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                table = pa.Table.from_batches(held)
                yield from blocks(table, False)
                held = table.slice(rows // block * block).to_batches()
                rows %= block
        if rows:
            yield from blocks(pa.Table.from_batches(held), True)

    made = ordered(vectors, dim).mapInArrow(cut, "n long, low array<long>, high array<long>, sums array<long>, ids array<long>, packed binary")
    return staged(made, "centroid-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of each box (n x dim) and centroid: whether some vector of the box may be nearest to it (n x k)."""
    near = np.zeros((len(low), len(centroids)), np.int64)
    far = near.copy()
    for c, x in enumerate(centroids):
        near[:, c] = (np.maximum(0, np.maximum(low - x, x - high)) ** 2).sum(1)
        far[:, c] = (np.maximum(np.abs(x - low), np.abs(high - x)) ** 2).sum(1)
    return near <= far.min(1, keepdims=True)


def nearest(m: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids numbered ``among`` (ascending; ties: the first), and its squared distance, of each vector."""
    distances = np.stack([((m - centroids[c]) ** 2).sum(1) for c in among], 1)
    best = distances.argmin(1)
    return among[best], distances[np.arange(len(m)), best]


def cluster_sums(blocks: DataFrame, centroids: np.ndarray, dim: int = DIM) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and component sums of every non-empty cluster: partial sums per task, added up by cluster; ``k`` rows come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high, own = (_matrix(batch.column(k), dim) for k in (1, 2, 3))
            may = candidates(low, high, centroids)
            for row in range(batch.num_rows):
                among = np.flatnonzero(may[row])
                if len(among) == 1:
                    n[among[0]] += batch.column(0)[row].as_py()
                    sums[among[0]] += own[row]
                    continue
                m = np.frombuffer(batch.column(4)[row].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
                cluster, _ = nearest(m, centroids, among)
                n += np.bincount(cluster, minlength=len(n))
                for c in among:
                    sums[c] += m[cluster == c].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), *(pa.array(sums[some, d]) for d in range(dim))], ["cluster", "n", *(f"s{d}" for d in range(dim))])

    fields = ", ".join(["cluster int", "n long", *(f"s{d} long" for d in range(dim))])
    partial = blocks.select("n", "low", "high", "sums", "packed").mapInArrow(add, fields)
    whole = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(dim)))
    return {r["cluster"]: (r["n"], np.array([r[f"s{d}"] for d in range(dim)], np.int64)) for r in whole.collect()}


def assigned(blocks: DataFrame, centroids: np.ndarray, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            may = candidates(_matrix(batch.column(0), dim), _matrix(batch.column(1), dim), centroids)
            for row in range(batch.num_rows):
                m = np.frombuffer(batch.column(3)[row].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
                cluster, distance = nearest(m, centroids, np.flatnonzero(may[row]))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(2)[row].as_py(), pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return blocks.select("low", "high", "ids", "packed").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors that take part."""
    vectors = staged(whole_vectors(rows, dim, scale), "centroid-vectors")
    centroids = first_centroids(vectors, k)
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        unstage(vectors)
        return rows.sparkSession.createDataFrame([], kinds)
    blocks = zone_blocks(vectors, dim)
    unstage(vectors)
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(blocks, centroids, dim).items():
            centroids[c] = sums // n  # exact floor, of negative sums too
    out = staged(assigned(blocks, centroids, dim), "centroid-rows")
    unstage(blocks)
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())  # a row per centroid
    of = lambda values: _by_cluster(values, len(centroids))
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return out.select("vec_id", "cluster", "distance", of([inertia.get(c, 0) for c in range(len(centroids))]).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(hashes).alias("centroid_sha256"))


def _by_cluster(values: list, k: int) -> Column:
    kind = "long" if isinstance(values[0], int) else "string"
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values[:k])), F.col("cluster") + 1)


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
