"""Operator 5: shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups.

Equal texts form a group that stays in one shard. Groups are dealt into buckets of bounded size by a hash.
In each bucket differencing repeatedly combines the two partial partitions of largest spread, oppositely
ordered, until one is left; the buckets' partial partitions are combined the same way, 256 at a time,
until one is left for all. Since differencing combines partial partitions of any history, the tree
keeps its balance, and no task sees more than a bucket or 256 vectors of shard sums.

Cases: null and empty texts are one group of size 1 each row; repeated rows are rows of their own;
ties in spread go by arrival order of sorted groups; an empty table gives no rows; other columns
are ignored. A group above a shard's fair share fills a shard alone, and the others stay even.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_key, running_sums, scratch, spread, staged

FAN_IN = 256


def difference(parts: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions (each k sums) into one.

    Returns, for every input and its slot, the slot of the result; and the result's sums.
    """
    k = len(parts[0])
    nodes: list[tuple] = []  # (None, order) for an input; (left, right, left's slots, right's slots) for a pair
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda s: -sums[s])
        ranked = [sums[s] for s in order]
        nodes.append((None, order))
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        joined = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=lambda s: -joined[s])
        ranked = [joined[s] for s in order]
        nodes.append((a, b, order, [k - 1 - s for s in order]))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    out: list[list[int]] = [[0] * k for _ in parts]
    stack = [(heap[0][1], list(range(k)))]
    while stack:
        at, slots = stack.pop()  # slots: the result's slot of each ranked slot of this node
        node = nodes[at]
        if node[0] is None:
            for ranked, own in enumerate(node[1]):
                out[at][own] = slots[ranked]
        else:
            a, b, from_a, from_b = node
            of_a, of_b = [0] * k, [0] * k
            for ranked in range(k):
                of_a[from_a[ranked]] = slots[ranked]
                of_b[from_b[ranked]] = slots[ranked]
            stack += [(a, of_a), (b, of_b)]
    return out, heap[0][2]


def shard_groups(groups: DataFrame, shards: int, each: int = 4000) -> DataFrame:
    """(g, bytes) -> (g, shard): every group's shard."""
    groups = staged(groups, "shard-groups")
    buckets = spread(groups.count(), each)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True])
        slots, _ = difference([[int(b)] + [0] * (shards - 1) for b in pdf["bytes"]])
        return pd.DataFrame({"bucket": pdf["bucket"], "g": pdf["g"], "bytes": pdf["bytes"], "label": [s[0] for s in slots]})

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("g", F.lit(3)), F.lit(buckets)))
    dealt = staged(dealt.groupBy("bucket").applyInPandas(local, "bucket long, g long, bytes long, label int"), "shard-local")
    names = dealt.select("bucket", "label").distinct().select("*", F.col("bucket").alias("top"), F.col("label").alias("shard"))
    sums = dealt.groupBy(F.col("bucket").alias("top"), F.col("label").alias("slot")).agg(F.sum("bytes").alias("bytes"))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        tops = sorted(pdf["top"].unique())
        rows = {t: [0] * shards for t in tops}
        for t, s, b in zip(pdf["top"], pdf["slot"], pdf["bytes"]):
            rows[t][s] += int(b)
        slots, _ = difference([rows[t] for t in tops])
        return pd.DataFrame([(t // FAN_IN, t, s, rows[t][s], slots[i][s]) for i, t in enumerate(tops) for s in range(shards)], columns=["parent", "top", "slot", "bytes", "to"])

    while buckets > 1:
        step = sums.withColumn("parent", F.expr(f"top div {FAN_IN}")).groupBy("parent").applyInPandas(combine, "parent long, top long, slot int, bytes long, to int")
        step = staged(step, "shard-step")
        names = names.join(step.select("top", F.col("slot").alias("shard"), "parent", "to"), ["top", "shard"]).select("bucket", "label", F.col("parent").alias("top"), F.col("to").alias("shard"))
        sums = step.groupBy(F.col("parent").alias("top"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        buckets = -(-buckets // FAN_IN)
    return dealt.join(names.select("bucket", "label", "shard"), ["bucket", "label"]).select("g", "shard")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document's shard and its place there: doc_id, size, text_crc32, shard, slot, group_hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g")),
        "shard-rows",
    )
    of = shard_groups(rows.groupBy("g").agg(F.sum("size").alias("bytes")), shards)
    placed = rows.withColumn("k_", fresh_key("g")).join(of.select(fresh_key("g").alias("k_"), "shard"), "k_").drop("k_")
    placed = staged(placed.withColumn("u_", F.xxhash64("doc_id", "g", F.lit(5))).withColumn("tie_row", F.col("row_id")), "shard-placed")
    sizes = staged(placed.groupBy("shard").agg(F.count("*").alias("n_rows")), "shard-sizes")
    placed = running_sums(placed, ["shard"], "u_", F.lit(1).cast("long"), "slot", sizes)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", F.col("g").alias("group_hash"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        return keep(placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "shard-slots")
