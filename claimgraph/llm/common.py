"""What several operators need: staged tables in the shared folder, skew-safe joins, distributed ranks and components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.iterate import scratch, ship, staged, unstage

WORD = r"[^\x20\x09-\x0D]+"


def fresh_key(key: Column | str) -> Column:
    """A key that no operator below is partitioned by.

    Joined on it, both sides get an exchange of their own right below the join, which adaptive
    execution may split where a hot key makes a partition large. An aggregate's own partitioning by
    ``key`` could not be split.
    """
    key = F.col(key) if isinstance(key, str) else key
    return F.xxhash64(key, F.lit(7))


#: Bits of a membership filter for a member, and the most bits: its broadcast has 2^20 rows at most.
BITS_EACH, MOST_BITS = 16, 26


class Membership:
    """A bit filter over 64-bit keys, sized by its members up to a bound, staged as (word_, bits_).

    Beyond the bound it lets more and more non-members pass, which costs a shuffle of their rows but no result.
    """

    def __init__(self, members: DataFrame, key: Column):
        keys = members.select(key.alias("at_"))
        self.bits = min(MOST_BITS, max(16, (BITS_EACH * keys.count()).bit_length()))
        one = F.expr("shiftleft(1L, cast(at_ & 63 as int))")
        keys = keys.select(F.pmod("at_", F.lit(1 << self.bits)).alias("at_"))
        self.words = staged(keys.groupBy(F.shiftright("at_", 6).alias("word_")).agg(F.bit_or(one).alias("bits_")), "members")

    def mark(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """Adds ``out``: false where the key is surely no member (rows that needn't be shuffled to find that out)."""
        at = F.pmod(key, F.lit(1 << self.bits))
        marked = df.withColumn("at_", at).join(F.broadcast(self.words), F.shiftright("at_", 6) == F.col("word_"), "left")
        hit = F.coalesce(F.expr("bit_get(bits_, cast(at_ & 63 as int)) = 1"), F.lit(False))
        return marked.withColumn(out, hit).drop("at_", "word_", "bits_")


def bit_filter(rows: DataFrame, derive, most_bits: int) -> np.ndarray:
    """Bits of 64-bit hashes as one array, put together by the cluster: 16 for each row, 2^most_bits at most (16 MB at 27).

    ``derive`` makes the hashes out of a batch's columns. What isn't among the rows passes seldom, more often beyond the bound.
    """
    bits = min(most_bits, max(16, (BITS_EACH * rows.count()).bit_length()))

    def places(batches):
        for batch in batches:
            hashes = derive([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array((hashes & np.uint64((1 << bits) - 1)).astype(np.int64))], ["at"])

    words = rows.mapInArrow(places, "at long").groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    # packed by the tasks: a range of 2^16 bits each, so that the driver only puts bytes together
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1024, np.int64)
        own[pdf["word"].to_numpy() & 1023] = pdf["bits"]
        return pd.DataFrame({"range": [int(pdf["word"].iloc[0]) >> 10], "bits": [own.tobytes()]})

    packed = words.groupBy(F.shiftright("word", 10).alias("range")).applyInPandas(pack, "range long, bits binary").collect()
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in packed:
        own = r["range"] * 1024
        out[own : own + 1024] = np.frombuffer(r["bits"], np.int64)[: len(out) - own]
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the filter's."""
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def running_sums(df: DataFrame, groups: list[str], order: str, value: Column, out: str, sizes: DataFrame) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group, by ``order``.

    ``order`` is a uniform 64-bit hash (ties broken by the columns named in ``tie_``). Each group is dealt
    into about sqrt(rows) ranges of that hash (``sizes``, a staged table with ``groups`` and ``n_rows``,
    is broadcast by the planner while it is small), so neither
    the rows of one range nor the ranges of one group grow faster than the root of a group: no task ever
    holds a whole hot group. Sums inside ranges and offsets of ranges are two small windows.
    """
    parts = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n_rows").cast("double")))).cast("long")
    lifted = df.join(sizes.select(*groups, parts.alias("parts_")), groups)
    unit = F.pmod(F.shiftrightunsigned(F.col(order), 11).cast("double") / F.lit(float(1 << 53)), F.lit(1.0))
    lifted = lifted.withColumn("range_", F.floor(unit * F.col("parts_")).cast("long")).withColumn("value_", value)
    ties = [c for c in df.columns if c.startswith("tie_")]
    totals = lifted.groupBy(*groups, "range_").agg(F.sum("value_").alias("total_"))
    before = Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset_", F.coalesce(F.sum("total_").over(before), F.lit(0))).drop("total_")
    inner = Window.partitionBy(*groups, "range_").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = lifted.withColumn("inner_", F.coalesce(F.sum("value_").over(inner), F.lit(0)))
    return summed.join(offsets, [*groups, "range_"]).withColumn(out, F.col("inner_") + F.col("offset_")).drop("inner_", "offset_", "range_", "parts_", "value_")


#: Up to this many links are joined up in one task (some 50 MB of Python numbers); beyond, by rounds of star steps over all executors.
FEW_LINKS = 1 << 18


def _joined_up(batches):
    """Union-find over all batches of (a, b): node and the smallest node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(root, nodes)), pa.int64())], ["node", "component"])


def connected_components(links: DataFrame, most_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(a, b) long links -> (node, component): each linked node with the smallest node reachable from it.

    Few links are joined up by one task. More take alternating large-star and small-star steps (Kiveris et
    al., 2014) over a staged edge table: rounds grow with the logarithm of a component's size, and
    only one number per round comes to the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_joined_up, "node long, component long")
    last = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        # large star: neighbours above a hang on the smallest of a's neighbourhood
        large = both.withColumn("k_", fresh_key("a")).join(small.select(fresh_key("a").alias("k_"), "m"), "k_").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(small.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        # small star: neighbours below a, and a itself, hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.withColumn("k_", fresh_key("a")).join(low.select(fresh_key("a").alias("k_"), "m"), "k_").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = down.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = staged(step, "links")
        key = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(edges)
        edges = nxt
        if tuple(key) == last:
            break
        last = tuple(key)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def spread(total: int, each: int) -> int:
    """How many parts of about ``each`` rows ``total`` rows make; at least one."""
    return max(1, math.ceil(total / max(1, each)))
