"""Operator 6: exact Jaccard self-join of word-shingle sets by token-combination prefixes.

Documents with equal sets are one set from the start. A token (shingle) order puts rare tokens first, by
hash, and tokens of the frequent class last, by frequency. Take what two similar sets have in common in that
order: either its first token is rare and lies in the prefix of both, or all of it is frequent
and its first k tokens lie in the prefixes extended by k - 1. So the index holds single rare tokens of the
prefix, and combinations of two frequent tokens of the extended prefix: these fall into k - 1 groups by a
hash, so k of them put two into one group, and only pairs inside a group are indexed, per pair of
size classes. Each entry knows the largest partner its place in the prefix still allows.

Candidates are compared exactly, but not all within a key: first each set with its key's leader (the
set with the fewest rare tokens). What is linked becomes one component; keys whose sets are in one component
are done, as are sets that are too large for every partner in the key. What is still apart is compared
within the remaining keys. No key or candidate is capped. A parity sketch of 512 bits (2048 for large sets) bounds the difference of two sets from below and drops hopeless
candidates without error before the sets are fetched.

Cases: null texts and texts without words have an empty set, link with nothing and are their own
component; texts with fewer words than a shingle have their whole sequence as one; repeated rows fall into one
component; null doc_ids count only in classes without any other; ties of the token order go by hash; an empty table
gives no rows; other columns are ignored. Sets are told apart by 54-bit hashes, tokens by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Membership, connected_components, fresh_key, scratch, staged, unstage
from .words import mix64, shingles, text_bytes, word_hashes, word_spans

STEP = 400
#: Tokens of more sets than this belong to the frequent class; at most 2^20 tokens do, so it can be broadcast.
FREQUENT, FREQUENT_BITS = 8, 20
#: The index is made, joined and removed in so many parts of its keys, so that only one part is on disk at a time.
PARTS = 4
#: Bits of a set's hash; above them an index entry holds its place in the choice of leaders.
WHOLE_BITS = 54
_TOKEN = np.uint64((1 << 48) - 1)


def token_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 48-bit tokens of each text's shingle set, first of each text (len + 1), 54-bit hash of each set."""
    values, offsets = text_bytes(column)
    starts, ends, first = word_spans(values, offsets)
    hashes, at = shingles(word_hashes(values, starts, ends), first, size)
    n = len(at) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    keys = np.sort((doc << np.uint64(48)) | (hashes >> np.uint64(16)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    rows = (keys >> np.uint64(48)).astype(np.int64)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    tokens = keys & _TOKEN
    whole = np.zeros(n, np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        whole[full] = mix64(np.add.reduceat(mix64(tokens), first[full]) ^ mix64(count[full].astype(np.uint64))) >> np.uint64(64 - WHOLE_BITS)
    return tokens, first, whole


#: Bits of the parity sketch of sets of up to WIDE tokens, and of larger ones.
SKETCH, WIDE_SKETCH, WIDE = 512, 2048, 512


def sketches(tokens: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Parity of the tokens in each bin, 64 bins to a number."""
    n = len(first) - 1
    sizes = np.diff(first)
    row = np.repeat(np.arange(n), sizes)
    bins = (mix64(tokens) & np.uint64(WIDE_SKETCH - 1)).astype(np.int64)
    odd = np.bincount(row * WIDE_SKETCH + bins, minlength=n * WIDE_SKETCH).astype(np.uint8).reshape(n, WIDE_SKETCH) & 1
    wide = sizes > WIDE
    short = np.bitwise_xor.reduce(odd.reshape(n, WIDE_SKETCH // SKETCH, SKETCH), axis=1)
    length = np.where(wide, WIDE_SKETCH, SKETCH) // 64
    ends = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(ends[-1], np.int64)
    for some, bits in ((wide, odd), (~wide, short)):
        if some.any():
            packed = np.packbits(bits[some], axis=1).view(np.int64)
            out[np.repeat(ends[:-1][some], packed.shape[1]) + np.tile(np.arange(packed.shape[1]), int(some.sum()))] = packed.ravel()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def measure(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key_, n, whole, sketch) of every document: hash of doc_id and text; tokens, hash and parity sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, STEP):
                batch = big.slice(low, STEP)
                tokens, first, whole = token_sets(batch.column(0), size)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(np.diff(first)), pa.array(whole.view(np.int64)), sketches(tokens, first)], ["doc_id", "key_", "n", "whole", "sketch"])

    return docs.select("text", "doc_id", F.xxhash64("doc_id", "text").alias("key_")).mapInArrow(run, "doc_id long, key_ long, n long, whole long, sketch array<long>")


def count_tokens(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, n): in how many sets a token lies in the prefix by hash, or recurs in a partition beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()
        rows = 0

        def counted() -> Iterator[pa.RecordBatch]:
            tokens, at, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
            inside = np.bincount(at, np.concatenate([h[1] for h in held]), len(tokens)) > 0
            some = np.flatnonzero(inside | (n > 1))
            for low in range(0, len(some), 100_000):
                part = some[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[part].view(np.int64)), pa.array(n[part])], ["token", "n"])

        for big in batches:
            for low in range(0, big.num_rows, STEP):
                tokens, first, whole = token_sets(big.column(0).slice(low, STEP), size)
                fresh = np.array([first[i + 1] > first[i] and w not in seen and not seen.add(w) for i, w in enumerate(whole.tolist())], bool)
                n = np.diff(first)
                rank = np.arange(len(tokens)) - np.repeat(first[:-1], n)
                inside = rank < np.repeat(n + percent * -n // 100 + 1, n)
                mine = np.repeat(fresh, n)
                held.append((tokens[mine], inside[mine]))
                rows += int(mine.sum())
                if rows > 2_000_000:  # bounded memory
                    yield from counted()
                    held, rows = [], 0
        if held:
            yield from counted()

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_tokens(docs: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens of the frequent class, and each one's place in its order (rarest first).

    A token of more than FREQUENT sets is frequent; where that would make the class larger than its bound, the
    least doubling of FREQUENT that keeps to the bound is taken. Any class gives the same links.
    """
    counts = staged(count_tokens(docs, size, percent).where(F.col("n") > FREQUENT), "near-frequent")
    sizes = counts.agg(*(F.count_if(F.col("n") > FREQUENT << k).alias(f"c{k}") for k in range(40))).first()
    step = next(k for k in range(40) if sizes[k] <= 1 << FREQUENT_BITS)
    rows = counts.where(F.col("n") > FREQUENT << step).toPandas()
    unstage(counts)
    tokens, n = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    place = np.empty(len(tokens), np.int64)
    place[np.lexsort((tokens, n))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], place[order]


#: Size classes of frequent combinations are this far apart.
WIDER = 1.08


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(WIDER) + 1e-9).astype(np.int64)


def index_entries(tokens: np.ndarray, first: np.ndarray, frequent: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Index entries of the sets: key, set, rare tokens per thousand of the set, largest partner."""
    n = np.diff(first)
    sets = len(n)
    row = np.repeat(np.arange(sets), n)
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    common = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    rare_n = np.bincount(row[~common], minlength=sets)
    thousandth = (1000 * rare_n) // np.maximum(n, 1)
    # single rare tokens of the prefix
    rare = np.flatnonzero(~common)
    rank = np.arange(len(rare)) - np.searchsorted(row[rare], row[rare])
    inside = rank < (n + percent * -n // 100 + 1)[row[rare]]
    picked, rank = rare[inside], rank[inside]
    owner = row[picked]
    keys, owners, most = [mix64(tokens[picked])], [owner], [(n[owner] - rank) * (100 + percent) // percent - n[owner]]
    # combinations of frequent tokens, for each size class that a partner may have
    often = np.flatnonzero(common)
    order = often[np.lexsort((place[at[often]], row[often]))]
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order]) + rare_n[row[order]]
    own = size_class(n)
    reach = int(np.ceil(np.log(100 / percent) / np.log(WIDER))) + 1
    for far in range(-reach, reach + 1):
        other = own + far
        edge = np.ceil(WIDER ** other.astype(float) - 1e-6).astype(np.int64)  # the least size in the partner's class
        least = np.maximum(edge, -(percent * -n // 100))
        possible = (other >= 0) & (edge <= 100 * n // percent) & (WIDER ** (other + 1.0) >= percent * n / 100)
        smaller = np.floor(WIDER ** np.minimum(own, other).astype(float)).astype(np.int64)
        groups = np.where(smaller < 256, 1, smaller // 48)  # more groups: fewer pairs, a longer prefix
        need = -(percent * -(n + least) // (100 + percent))
        prefix = np.where(possible, n - need + groups + 1, 0)
        some = np.flatnonzero(rank < prefix[row[order]])
        if not len(some):
            continue
        r, t, o = rank[some], tokens[order[some]], row[order[some]]
        group = (mix64(t ^ np.uint64(0xA5A5)) % groups[o].astype(np.uint64)).astype(np.int64)
        by = np.lexsort((r, group, o))
        o, t, group, r = o[by], t[by], group[by], r[by]
        tag = mix64(np.minimum(own, other).astype(np.uint64) * np.uint64(4096) + np.maximum(own, other).astype(np.uint64))
        step = 1
        while step < len(o):  # pairs at distance step inside runs of equal set and group
            hit = np.flatnonzero((o[step:] == o[:-step]) & (group[step:] == group[:-step]))
            if not len(hit):
                break
            who = o[hit]
            keys.append(mix64(mix64(t[hit] ^ tag[who]) * np.uint64(3) + t[hit + step]))
            owners.append(who)
            most.append((n[who] - r[hit + step] + groups[who]) * (100 + percent) // percent - n[who])
            step += 1
    owner = np.concatenate(owners)
    return np.concatenate(keys), owner, thousandth[owner], np.concatenate(most)


def index(docs: DataFrame, size: int, percent: int, shared, part: int) -> DataFrame:
    """(key, id, n, most) for every set and each of its keys in ``part``: id is the set's hash below its share of rare tokens,
    most its largest partner at that key. ``shared`` is the broadcast frequent class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_, place = shared.value
        seen: set[int] = set()
        for big in batches:
            for low in range(0, big.num_rows, STEP):
                tokens, first, whole = token_sets(big.column(0).slice(low, STEP), size)
                fresh = np.array([first[i + 1] > first[i] and w not in seen and not seen.add(w) for i, w in enumerate(whole.tolist())], bool)
                tokens = tokens[np.repeat(fresh, np.diff(first))]
                whole, n = whole[fresh], np.diff(first)[fresh]
                if not len(n):
                    continue
                key, owner, rare, most = index_entries(tokens, np.concatenate([[0], np.cumsum(n)]), tokens_, place, percent)
                mine = np.flatnonzero(key % np.uint64(PARTS) == np.uint64(part))
                key, owner, most = key[mine], owner[mine], most[mine]
                ids = whole[owner] | (rare[mine] * 511 // 1000).astype(np.uint64) << np.uint64(WHOLE_BITS)
                columns = [key.view(np.int64), ids.view(np.int64), n[owner].astype(np.int32), most.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "id", "n", "most"])

    return docs.select("text").mapInArrow(run, "key long, id long, n int, most int")


def _hopeful(percent: int) -> Column:
    """Whether sets of n and n2 tokens whose sketches differ in so many bits can be similar enough; sketches of two lengths don't tell."""
    differ = F.aggregate(F.zip_with("sketch", "sketch2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    both = F.col("n") + F.col("n2")
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & ((F.size("sketch") != F.size("sketch2")) | ((100 + percent) * (both - differ) >= 2 * percent * both))


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` whose exchanges adaptive execution may split, whatever is grouped by ``key`` before or after."""
    other = [F.col(c) for c in right.columns if c != key]
    return left.withColumn("k_", fresh_key(key)).join(right.select(fresh_key(key).alias("k_"), *other), "k_").drop("k_")


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity reaches the threshold, compared in full; ``pairs`` is distinct.

    A set is fetched as the text of its one document; those that stand first in pairs (leaders, fewer) travel last.
    """
    one = sets.select(F.col("whole").alias("a"), "n", "sketch", F.col("doc_id").alias("doc_a"))
    two = sets.select(F.col("whole").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"), F.col("doc_id").alias("doc_b"))
    close = _joined(_joined(pairs, one, "a"), two, "b").where(_hopeful(percent))
    key = lambda doc, whole: F.xxhash64(doc, whole)
    close = staged(close.select("a", "b", "n", "n2", key("doc_a", "a").alias("key_a"), key("doc_b", "b").alias("key_b"), "doc_a", "doc_b"), "near-close")
    ids = F.xxhash64("doc_id")
    members = [staged(close.select(F.col(c).alias("doc_id")).distinct(), "near-wanted") for c in ("doc_a", "doc_b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, STEP):
                batch = big.slice(low, STEP)
                tokens, first, whole = token_sets(batch.column(0), size)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(tokens.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(whole.view(np.int64)), batch.column(2), batch.column(3), lists], ["doc_id", "whole", "as_a", "as_b", "tokens"])

    # texts stay where they are: bit filters keep those of the wanted documents and a few others
    texts = docs.select("doc_id", "text")
    for df, name in zip(members, ("as_a", "as_b")):
        texts = Membership(df, ids).mark(texts, ids, name)
    texts = texts.where("as_a or as_b").select("text", "doc_id", "as_a", "as_b")
    full = texts.mapInArrow(run, "doc_id long, whole long, as_a boolean, as_b boolean, tokens array<long>").where("size(tokens) > 0")
    full = staged(full.select(key("doc_id", "whole").alias("key"), "as_a", "as_b", "tokens"), "near-full")
    if not full.groupBy("key").count().where("count > 1").isEmpty():  # repeated rows
        once = staged(full.dropDuplicates(["key"]), "near-full")
        unstage(full)
        full = once
    joined = _joined(close.select("a", "b", "n", "n2", "key_a", "key_b"), full.where("as_b").select(F.col("key").alias("key_b"), F.col("tokens").alias("tokens2")), "key_b").drop("key_b")
    joined = _joined(joined, full.where("as_a").select(F.col("key").alias("key_a"), "tokens"), "key_a")
    shared = F.size(F.array_intersect("tokens", "tokens2"))
    found = staged(joined.where((100 + percent) * shared >= percent * (F.col("n") + F.col("n2"))).select("a", "b"), "near-links")
    unstage(close, full, *members)
    return found


def _apart(entries: DataFrame, components: DataFrame) -> DataFrame:
    """Entries of keys in which sets of different components could still link; drops sets too large for all others there."""
    known = components.select(fresh_key("node").alias("w_"), "component")
    rows = entries.withColumn("w_", fresh_key("whole")).join(known, "w_", "left").drop("w_")
    rows = staged(rows.withColumn("component", F.coalesce("component", "whole")), "near-rows")
    keys = rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("n").alias("smallest")).where("c1 <> c2")
    live = _joined(rows, keys.select("key", "smallest"), "key").where("most >= smallest").drop("smallest")
    out = staged(live, "near-apart")
    unstage(rows)
    return out


def led_entries(entries: DataFrame, percent: int) -> DataFrame:
    """(key, whole, n, most, whole2, m) of the entries that may have a partner: m at their key, whose leader is whole2.

    What no partner of the key can fit is left out: all are too large for the place of the key, or too small for the set.
    """
    heads = entries.groupBy("key").agg(F.min("id").alias("id2"), F.count("*").alias("m"), F.min("n").alias("smallest"), F.max("n").alias("largest")).where("m > 1")
    heads = heads.select(fresh_key("key").alias("key"), "id2", "m", "smallest", "largest")
    led = entries.select(fresh_key("key").alias("key"), "id", "n", "most").join(heads, "key")
    led = led.where(f"most >= smallest and 100 * largest >= {percent} * n")
    whole = [F.col(c).bitwiseAND(F.lit((1 << WHOLE_BITS) - 1)) for c in ("id", "id2")]
    return led.select("key", whole[0].alias("whole"), "n", "most", whole[1].alias("whole2"), "m")


def link_sets(docs: DataFrame, sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect every two sets connected by similar pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    pair = [F.least("whole", "whole2").alias("a"), F.greatest("whole", "whole2").alias("b")]
    parts = []
    for part in range(PARTS):
        entries = staged(index(docs, size, percent, shared, part), "near-index")
        parts.append(staged(led_entries(entries, percent), "near-led"))
        unstage(entries)
    led = reduce(DataFrame.union, parts)
    # the leader has the lesser id of the two, so a pair stands one way only
    links = verify(led.where("whole <> whole2").select(F.col("whole2").alias("a"), F.col("whole").alias("b")).distinct(), docs, sets, size, percent)
    components = staged(connected_components(links), "near-components")
    rows = _apart(led.where("m > 2").drop("whole2", "m"), components)
    unstage(*parts)
    two = rows.select(fresh_key("key").alias("k_"), F.col("whole").alias("whole2"), F.col("n").alias("n2"), F.col("most").alias("most2"), F.col("component").alias("component2"))
    rest = rows.withColumn("k_", fresh_key("key")).join(two, "k_").where("whole < whole2 and component <> component2 and n <= most2 and n2 <= most")
    return links.union(verify(rest.select(*pair).distinct(), docs, sets, size, percent))


def _classed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``measure`` of the documents; and (doc_id, whole, component) of every set: its least doc_id, hash and class."""
    measured = staged(measure(docs, size), "near-measured")
    sets = measured.where("n > 0").groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = staged(sets, "near-sets")
    links = link_sets(docs, sets, frequent_tokens(docs, size, percent), size, percent)
    components = staged(connected_components(links), "near-components")
    of = sets.select(fresh_key("whole").alias("k_"), "doc_id", "whole").join(components.select(fresh_key("node").alias("k_"), "component"), "k_", "left")
    out = staged(of.select("doc_id", "whole", F.coalesce("component", "whole").alias("component")), "near-of")
    unstage(sets, components)
    return measured, out


def similar_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id connected by similar pairs) and whole (the set's hash)."""
    measured, of = _classed(docs, size, percent)
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = of.withColumn("k_", fresh_key("component")).join(least.select(fresh_key("component").alias("k_"), "component_id"), "k_")
    rows = measured.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("whole")).alias("whole"))
    out = rows.withColumn("k_", F.coalesce(fresh_key("whole"), F.xxhash64("doc_id")))
    out = out.join(of.select(fresh_key("whole").alias("k_"), "component_id"), "k_", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "whole")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class of similar ones: the one with the least doc_id (null last); all columns stay.

    Ids needn't be there or be unique: documents are told apart by doc_id and text, and rows alike in both are one.
    Documents without words are like no other.
    """
    measured, of = _classed(docs, size, percent)
    best = measured.where("n > 0").groupBy("whole").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")).alias("best"))
    classed = best.withColumn("k_", fresh_key("whole")).join(of.select(fresh_key("whole").alias("k_"), "component"), "k_")
    first = classed.groupBy("component").agg(F.min(F.struct("best.none", "best.doc_id", "whole", "best.key_")).alias("first"))
    kept = staged(first.select("first.key_").union(measured.where("n = 0").select("key_")).distinct(), "near-kept")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("key_"))
    return packed.join(kept, "key_", "left_semi").dropDuplicates(["key_"]).select("doc.*")


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        return keep(similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85).drop("whole"), "near-classes")
