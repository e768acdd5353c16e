"""Operator 11: phrase collocations by prefix-free parsing (Boucher et al., 2019), on words.

Texts are cut into pieces, and pieces into overlapping chunks: a chunk begins where a piece does or where two words
hash to a trigger, owns the words up to the next beginning and carries the LONGEST - 1 words after them. So equal passages
give equal chunks wherever they stand, and every phrase lies whole in the chunk that owns its first word: it is counted there, once.
The distinct chunks with their frequencies (the dictionary) stand for the corpus. Phrases are counted inside distinct
chunks, weighted by their frequency, one length after the other.

A phrase can only reach ``least`` if what it leaves without its first and without its last word does. A bit filter of these
(2^28 bits at most) keeps other phrases from being shuffled; where it lets one through, that costs a row and no result.
Counts are exact, by the phrases themselves.

Cases: null or empty texts have no words; a null lang counts as ``und``; pieces without words give nothing; very long pieces are
cut like others (a piece without triggers is one chunk); rows are documents of their own, repeated ones too; ties of cuts go to
the smallest, ties of phrases to larger counts and then to byte order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unstage
from .words import LOWER, mix64, text_bytes, word_hashes, word_spans

LEAST, LONGEST, TOP = 100, 5, 2000
#: One in so many pairs of words begins a chunk; texts parsed at once; rows that a task holds before it sums them up.
TRIGGER, STEP, HELD = 8, 400, 400_000
BITS_EACH, MOST_BITS = 16, 28
#: Ranks are taken in so many parts of a language first.
PARTS = 16

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_OUTSIDE = _PIECE.copy()
_OUTSIDE[[0x20, 0x09]] = True
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True


def _slices(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``values`` as strings; they may overlap."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(values[at].tobytes())]).cast(pa.string())


def chunks_of(column: pa.Array, trigger: int = TRIGGER, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all texts of ``column``: text, number of words owned, and words joined by blanks, of every chunk."""
    values, offsets = text_bytes(column)
    starts, ends, first = word_spans(values, offsets, _OUTSIDE)
    n = len(starts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not n:
        return row, row, pa.array([], pa.string())
    breaks = np.cumsum(_PIECE[values])[starts]
    opens = np.ones(n, bool)
    opens[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    hashes = word_hashes(values, starts, ends)
    begins = opens.copy()
    begins[1:] |= mix64(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]) % np.uint64(trigger) == 0
    begin, piece = np.flatnonzero(begins), np.flatnonzero(opens)
    end = np.append(begin[1:], n)  # a piece's first word begins a chunk, so none runs over a piece's end
    last = np.minimum(end + longest - 1, np.append(piece, n)[np.searchsorted(piece, begin, "right")])
    # words behind each other, each followed by one blank
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    stream = np.full(at[-1], 0x20, np.uint8)
    source = np.repeat(starts - (at[:-1] - np.arange(n)), sizes) + np.arange(sizes.sum())
    stream[np.arange(sizes.sum()) + np.repeat(np.arange(n), sizes)] = LOWER[values[source]]
    return row[begin], end - begin, _slices(stream, at[begin], at[last] - 1)


def _summed(held: list[pa.Table], keys: list[str], value: str) -> Iterator[pa.RecordBatch]:
    table = pa.concat_tables(held).group_by(keys).aggregate([(value, "sum")]).select([*keys, f"{value}_sum"]).rename_columns([*keys, value])
    yield from table.to_batches(max_chunksize=20_000)


def dictionary(docs: DataFrame, trigger: int = TRIGGER, longest: int = LONGEST) -> DataFrame:
    """(lang, own, chunk, freq): the distinct chunks of the corpus, the words they own and how often they stand, staged."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                row, own, chunk = chunks_of(batch.column(1), trigger, longest)
                held.append(pa.table({"lang": batch.column(0).take(pa.array(row)), "own": pa.array(own, pa.int32()), "chunk": chunk, "freq": pa.array(np.ones(len(own), np.int64))}))
                rows += len(own)
                if rows > HELD:
                    yield from _summed(held, ["lang", "own", "chunk"], "freq")
                    held, rows = [], 0
        if held:
            yield from _summed(held, ["lang", "own", "chunk"], "freq")

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    parsed = texts.mapInArrow(parse, "lang string, own int, chunk string, freq long")
    return staged(parsed.groupBy("lang", "own", "chunk").agg(F.sum("freq").alias("freq")), "phrase-chunks")


class Words:
    """The words of a batch of chunks (or phrases): their bytes, places and hashes."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.values, offsets = text_bytes(texts)
        self.starts, self.ends, first = word_spans(self.values, offsets, _BLANK)
        counts = np.diff(first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.row)) - first[self.row]
        self.left = counts[self.row] - self.place
        self.hashes = word_hashes(self.values, self.starts, self.ends, lower=False)
        names, ends = text_bytes(langs)
        self.lang = word_hashes(names, ends[:-1], ends[1:], lower=False)

    def phrase_hashes(self, size: int) -> np.ndarray:
        """Of every word: hash of the phrase of ``size`` words that it starts, with the language (nothing where fewer are left)."""
        padded = np.concatenate([self.hashes, np.zeros(size, np.uint64)])
        out = self.lang[self.row]
        for k in range(size):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + padded[k : k + len(out)])
        return out


def phrase_filter(frequent: DataFrame, size: int) -> np.ndarray:
    """Bits of the hashes of all phrases (lang, phrase) of ``size`` words: 2^28 at most, 32 MB, put together by the cluster."""
    bits = min(MOST_BITS, max(16, (BITS_EACH * frequent.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(0), batch.column(1))
            at = words.phrase_hashes(size)[words.place == 0] & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    at = frequent.select("lang", "phrase").mapInArrow(places, "at long")
    table = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint64)


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def count_phrases(chunks: DataFrame, size: int, shorter: DataFrame | None = None) -> DataFrame:
    """(lang, phrase, f): occurrences of the phrases of ``size`` words, of those alone whose parts one word shorter may be in ``shorter``."""
    shared = chunks.sparkSession.sparkContext.broadcast(phrase_filter(shorter, size - 1)) if shorter is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            words = Words(batch.column(0), batch.column(2))
            own = batch.column(1).to_numpy()
            good = (words.place < own[words.row]) & (words.left >= size)
            if shared is not None:
                known = _in_filter(shared.value, words.phrase_hashes(size - 1))
                good &= known & np.append(known[1:], False)
            at = np.flatnonzero(good)
            row = pa.array(words.row[at])
            held.append(pa.table({"lang": batch.column(0).take(row), "phrase": _slices(words.values, words.starts[at], words.ends[at + size - 1]), "f": batch.column(3).take(row)}))
            rows += len(at)
            if rows > HELD:
                yield from _summed(held, ["lang", "phrase"], "f")
                held, rows = [], 0
        if held:
            yield from _summed(held, ["lang", "phrase"], "f")

    return chunks.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """For each length from 1 on: (lang, phrase, f) of the phrases that stand ``least`` times and more, staged."""
    out: list[DataFrame] = []
    for size in range(1, longest + 1):
        out.append(staged(count_phrases(chunks, size, out[-1] if out else None).where(F.col("f") >= least), f"phrases-{size}"))
    return out


def scored(levels: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one stands for.

    Only candidates one word longer need to be looked at: where a longer one is as frequent, so are all between.
    """
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    words = F.split("phrase", " ")
    part = lambda low, n: F.array_join(F.slice("w_", low, n), " ")
    sized = every.select("lang", "phrase", F.col("f").alias("a"), words.alias("w_")).where(F.size("w_") > 1)
    inner = sized.where(F.size("w_") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w_") - 1), part(F.lit(2), F.size("w_") - 1))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer_"))
    left = sized.join(covered, ["lang", "phrase"], "left").where("longer_ is null or longer_ < a").drop("longer_")
    cuts = left.select("lang", "phrase", "a", "w_", F.explode(F.sequence(F.lit(1), F.size("w_") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first_"), part(F.col("k") + 1, F.size("w_") - F.col("k")).alias("rest_"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("first_"), F.col("f").alias("l")), ["lang", "first_"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("rest_"), F.col("f").alias("r")), ["lang", "rest_"])
    cuts = cuts.join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    # exact: 37 digits above, 33 below, and the quotient is a long, since l and r are at least a
    cuts = cuts.withColumn("top_", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("low_", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top_ div low_"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    chunks = dictionary(docs, longest=longest)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own").cast("long") * F.col("freq")).alias("n"))
    totals = staged(totals, "phrase-totals")
    levels = frequent_phrases(chunks, least, longest)
    unstage(chunks)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = scored(levels, totals).withColumn("part_", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # a language may hold most of the candidates: the first of each part are found before the parts meet
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part_").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = staged(rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrase-ranks")
    unstage(totals, *levels)
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
