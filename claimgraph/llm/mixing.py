"""Operator 3: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. Each source's words form a stream: its documents in a hashed order, once per
epoch. The stream is cut into blocks of equal words; the sources' block quotas are split exactly among
the output shards by a binary tree, whose every node deals its quotas to its halves as one
multivariate-hypergeometric draw (selection sampling without replacement). The shards then draw disjoint
runs of each source's permuted blocks. What is taken of a document is what lies in blocks that a shard has drawn.

Cases: null and empty texts have size 0 and are never drawn; a null source is a source of its own and
stands last; repeated rows are documents of their own; an empty table gives no rows; other columns
are ignored. The last document of a source's quota is taken in part (``words`` < ``size``).
The one-row-per-source table is ordered in one task; everything per document is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running_sums, scratch, spread, staged

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def text_size(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, size) -> one row per source: rank, source_size, n_rows, weight, target, quota (whole words).

    Targets share the total by weight, none above ``most`` times its source: water filling. Sorted by
    cap / weight, the first source that stays under the level it would get fixes the level of all after it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    per = per.withColumn("target", F.least(target, F.col("cap").cast("double")))
    return per.withColumn("quota", F.least(F.round("target").cast("long"), F.col("cap"))).drop("level", "cap")


def _split(quotas: Column, left: Column, node: Column, seed: int) -> Column:
    """The left half's part of ``quotas`` (array of (rank, n)): ``left`` of all blocks drawn without replacement.

    Block by block, the chance to go left is the left places over the blocks that remain.
    """

    def chance(rank: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), node, rank, i), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def one(state: Column, i: Column, rank: Column) -> Column:
        goes = (chance(rank, i) * state["rest"] < state["left"]).cast("long")
        return F.struct((state["left"] - goes).alias("left"), (state["rest"] - 1).alias("rest"), (state["took"] + goes).alias("took"))

    def source(state: Column, q: Column) -> Column:
        start = F.struct(state["left"].alias("left"), state["rest"].alias("rest"), F.lit(0).cast("long").alias("took"))
        ids = F.when(q["n"] > 0, F.sequence(F.lit(1).cast("long"), q["n"])).otherwise(F.array().cast("array<bigint>"))
        after = F.aggregate(ids, start, lambda s, i: one(s, i, q["rank"]))
        return F.struct(after["left"].alias("left"), after["rest"].alias("rest"), F.concat(state["out"], F.array(F.struct(q["rank"].alias("rank"), after["took"].alias("n")))).alias("out"))

    rest = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q["n"])
    start = F.struct(left.cast("long").alias("left"), rest.alias("rest"), F.array().cast("array<struct<rank:int,n:bigint>>").alias("out"))
    return F.aggregate(quotas, start, source)["out"]


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, n) block quotas -> (shard, rank, n): the splitting tree over ``shards`` leaves.

    Counts only: a node is one row with an array of one entry per source.
    """
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("n").cast("long").alias("n")))).alias("quotas"))
    tree = tree.select(F.lit(0).alias("low"), F.lit(shards).alias("width"), "quotas")
    while shards > 1:
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q["n"])
        half = F.ceil(F.col("width") / 2).cast("int")
        node = F.xxhash64(F.col("low"), F.col("width"))
        wide = F.col("width") > 1
        left = F.when(wide, _split(F.col("quotas"), F.floor(total * half / F.col("width")), node, seed)).otherwise(F.col("quotas"))
        # each level reads its own rows once: the draw is made before the halves are laid out
        tree = tree.select("low", "width", "quotas", half.alias("half"), left.alias("left"))
        right = F.zip_with("quotas", "left", lambda q, l: F.struct(q["rank"].alias("rank"), (q["n"] - l["n"]).alias("n")))
        children = F.when(
            F.col("width") > 1,
            F.array(
                F.struct(F.col("low").alias("low"), F.col("half").alias("width"), F.col("left").alias("quotas")),
                F.struct((F.col("low") + F.col("half")).alias("low"), (F.col("width") - F.col("half")).alias("width"), right.alias("quotas")),
            ),
        ).otherwise(F.array(F.struct(F.col("low").alias("low"), F.col("width").alias("width"), F.col("quotas").alias("quotas"))))
        tree = tree.select(F.inline(children))
        shards = -(-shards // 2)
    return tree.select(F.col("low").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.rank", "q.n")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, shards: int = 16, blocks_per_shard: int = 64, seed: int = 20240601) -> DataFrame:
    """Draws of a mix, one row per document, epoch and block that it reaches into.

    Columns: row_id, key_ (of doc_id, text and source), doc_id, size, source_size, target, epoch,
    words (drawn with this block; 0 past the quota), block, shard (null if not drawn), local_order.
    """
    text, source = F.col("text"), F.col("source")
    sized = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", source, text_size(text).alias("size"), F.xxhash64("doc_id", text, source).alias("key_")
        ),
        "mix-sizes",
    )
    per = staged(source_targets(sized, weights, most), "mix-sources")
    block_words = per.agg(F.greatest(F.lit(1), F.ceil(F.sum("source_size") / (shards * blocks_per_shard))).cast("long").alias("block_words"))
    per = staged(per.crossJoin(block_words).withColumn("blocks", F.ceil(F.col("quota") / F.col("block_words")).cast("long")), "mix-quotas")

    dealt = split_quotas(per.select("rank", F.col("blocks").alias("n")), shards, seed)
    start = F.sum("n").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("start", F.coalesce(start, F.lit(0))).where("n > 0")
    dealt = dealt.select("rank", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("place"))
    blocks = per.where("blocks > 0").select("rank", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block"), "block")) - 1
    blocks = staged(blocks.withColumn("place", place.cast("long")).join(dealt, ["rank", "place"]).drop("place"), "mix-blocks")

    epochs = F.expr("sequence(0, greatest(0, cast(ceil(quota / greatest(1, source_size)) as int) - 1))")
    facts = per.select("source", "rank", "source_size", "target", "quota", "block_words", epochs.alias("epochs"))
    draws = sized.join(facts, sized.source.eqNullSafe(facts.source)).drop(facts.source)
    draws = draws.select("*", F.explode("epochs").alias("epoch")).drop("epochs")
    draws = draws.withColumn("u_", F.xxhash64(F.lit(seed + 2), "epoch", "key_")).withColumn("tie_key", F.col("key_")).withColumn("tie_row", F.col("row_id"))
    sizes = per.select("rank", F.explode(epochs).alias("epoch"), "n_rows")
    draws = running_sums(draws, ["rank", "epoch"], "u_", F.col("size"), "ahead", sizes)
    at = F.col("ahead") + F.col("epoch") * F.col("source_size")
    draws = draws.withColumn("at_", at).withColumn("to_", F.least(at + F.col("size"), F.col("quota")))
    # a document reaches from the block of its first word to that of its last; one past the quota keeps a row without block
    inside = F.expr("if(to_ > at_, sequence(cast(at_ div block_words as long), cast((to_ - 1) div block_words as long)), array(cast(null as long)))")
    draws = draws.select("*", F.explode(inside).alias("block"))
    start = F.col("block") * F.col("block_words")
    words = F.least(F.col("to_"), start + F.col("block_words")) - F.greatest(F.col("at_"), start)
    drawn = draws.withColumn("words", words).join(blocks, ["rank", "block"], "left")
    return drawn.select(
        "row_id", "key_", "doc_id", "size", "source_size", "target", "epoch", F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0).cast("long").alias("words"), "block", "shard",
        F.xxhash64(F.lit(seed + 3), "u_").alias("local_order"),
    )


def mixed_documents(docs: DataFrame, shard_column: str | None = None, slice_rows: int = 4000, **options) -> DataFrame:
    """The mixed table: each document as often as the mix draws it, with the columns of ``docs``.

    Documents stay whole here: one that a quota cuts is kept where at least half of it is drawn, in the shard of its first
    block. Rows alike in doc_id, text and source share their draws. Documents without words are not drawn.
    A shard is dealt in slices of about ``slice_rows`` rows of its shuffled order, so that no task holds a whole one; in a slice its
    rows lie in that order. ``shard_column`` adds the shard under that name.
    """
    whole = mix(docs, **options).where("words > 0").groupBy("key_", "row_id", "epoch")
    draws = whole.agg(F.sum("words").alias("words"), F.first("size").alias("size"), F.min_by("shard", "block").alias("shard"), F.first("local_order").alias("local_order"))
    draws = draws.where("2 * words >= size").select("key_", "shard", "local_order")
    cols = docs.columns
    slices = spread(docs.count(), slice_rows * options.get("shards", 16))
    own = docs.select(F.struct(*cols).alias("doc"), F.xxhash64("doc_id", "text", "source").alias("key_")).dropDuplicates(["key_"])
    mixed = own.join(draws, "key_").withColumn("slice_", F.floor((F.col("local_order") / 2.0**64 + 0.5) * slices))
    mixed = mixed.repartition("shard", "slice_").sortWithinPartitions("shard", "slice_", "local_order")
    return mixed.select(*(F.col("doc")[c].alias(c) for c in cols if c != shard_column), *([F.col("shard").alias(shard_column)] if shard_column else []))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        draws = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        taken = F.col("words") > 0
        out = draws.groupBy("row_id", "doc_id", "size", "source_size", "target").agg(
            F.sum("words").alias("taken"), F.count_distinct(F.when(taken, F.col("epoch"))).alias("draws"), F.array_sort(F.collect_set(F.when(taken, F.col("shard")))).alias("shards")
        )
        return keep(out.drop("row_id"), "mix-taken")
