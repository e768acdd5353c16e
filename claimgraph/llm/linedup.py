"""Operator 1: line dedup by winnowing: repeated passages go, wherever in a line they start or end.

A document is its sequence of words (A-Z lower-cased). Of every window of ``least`` words the least hash among its
shingles of half its words is selected, the leftmost of equal ones; windows in a row mostly select the same one, so a
document keeps about one fingerprint for every thirteen words: its hash, where it stands, and the run of windows
that selected it. Two equal windows select the same fingerprint, so no repeat is missed.

Positions are joined on fingerprints. Places of one fingerprint whose whole surroundings (all words of all windows that
selected it) are equal are matched at once, each with the first of them: neighbouring fingerprints extend such a match to both
sides. Where a fingerprint has different surroundings, the first place of each is extended window by
window to the left and right as far as its words agree. A hot passage therefore costs one row per place and
one extension per different surrounding; nothing is paired within a group.

Words are removed if they lie in a window that also stands earlier: in a document with a smaller (doc_id, text hash), or
further up in the same document without overlap. Only whole lines would miss passages spliced into the middle of a line;
lines of which words stay keep them, the others go.

Cases: a null text stays null; blank lines inside a removed span go with it; a null doc_id sorts first;
rows alike in doc_id and text count as one document and are changed alike; an empty table gives no rows; all
other columns pass through. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Membership, fresh_key, staged, unstage
from .words import mix64, text_bytes, word_hashes, word_spans

LEAST_WORDS = 50
#: Rows handled at a time, so that a batch of long texts stays small.
STEP = 400
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first one (len + 1)."""
    values, offsets = text_bytes(column)
    at, end, first = word_spans(values, offsets)
    return word_hashes(values, at, end), first


class Spans:
    """Hashes of any spans of a sequence of word hashes, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers, inverse = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        powers[1:], inverse[1:] = _R, _R_INVERSE
        powers, self.inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the words low up to high (exclusive)."""
        return mix64((self.sums[high] - self.sums[low]) * self.inverse[low])


def fingerprints(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Selected fingerprints of all texts: text, hash, hash of the surroundings, first window (word index), windows."""
    n, short = len(hashes), max(1, least // 2)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(n) + least <= first[1:][row]) if n else np.zeros(0, np.int64)
    if not len(start):
        return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64), start, start
    spans = Spans(hashes)
    at = np.arange(n - short + 1)
    small = spans.of(at, at + short)
    least_at, width = at, 1
    while width < least - short + 1:  # leftmost least shingle of each window, by doubling
        step = min(width, least - short + 1 - width)
        left, right = least_at[:-step], least_at[step:]
        least_at = np.where(small[right] < small[left], right, left)
        width += step
    picked = least_at[start]
    new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    runs = np.diff(np.concatenate([new, [len(start)]]))
    low, place = start[new], picked[new]
    around = mix64(spans.of(low, low + runs - 1 + least) ^ mix64(((place - low) * 4096 + runs).astype(np.uint64)))
    return row[low], small[place], around, low, runs


def document_fingerprints(keyed: DataFrame, least: int) -> DataFrame:
    """(mark, around, key_, doc_id, low, n) of all documents: n windows from word ``low`` on selected ``mark``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, STEP):
                batch = big.slice(low, STEP)
                hashes, first = words_of(batch.column(0))
                text, mark, around, start, runs = fingerprints(hashes, first, least)
                rows = pa.array(text)
                columns = [pa.array(mark.view(np.int64)), pa.array(around.view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows)]
                columns += [pa.array(start - first[text], pa.int32()), pa.array(runs, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "around", "key_", "doc_id", "low", "n"])

    return keyed.select("text", "key_", "doc_id").mapInArrow(run, "mark long, around long, key_ long, doc_id long, low int, n int")


def extended_windows(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(whole, doc_id, key_, first): every window of ``least`` words that ``wanted`` (key_, runs, least) asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, STEP):
                batch = big.slice(low, STEP)
                hashes, first = words_of(batch.column(1))
                lists = batch.column(3)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                start = lists.flatten().field("low").to_numpy(zero_copy_only=False).astype(np.int64)
                n = lists.flatten().field("n").to_numpy(zero_copy_only=False)
                owner, start = np.repeat(owner, n), np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                least = int(batch.column(4)[0].as_py()) if batch.num_rows else 0
                at = start + first[owner]
                whole = Spans(hashes).of(at, at + least)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(start, pa.int32())], ["whole", "doc_id", "key_", "first"])

    texts = keyed.join(wanted, "key_").select("doc_id", "text", "key_", "runs", "least")
    return texts.mapInArrow(run, "whole long, doc_id long, key_ long, first int")


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(key_, spans): spans of words (first, last) to remove, keyed by xxhash64(doc_id, text); staged."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key_"))
    found = staged(document_fingerprints(keyed, least), "line-marks")
    marks = found.groupBy("mark").agg(F.min("around").alias("a"), F.max("around").alias("b"), F.count("*").alias("places")).where("places > 1")
    marks = marks.select(fresh_key("mark").alias("m_"), (F.col("a") != F.col("b")).alias("mixed"))
    matched = staged(found.withColumn("m_", fresh_key("mark")).join(marks, "m_").drop("m_", "mark"), "line-matched")
    unstage(found)
    # equal surroundings: each place with the first of them
    firsts = matched.groupBy("around").agg(F.min(F.struct("doc_id", "key_", "low")).alias("at"), F.first("n").alias("n"), F.max("mixed").alias("mixed"), F.count("*").alias("places"))
    firsts = staged(firsts, "line-firsts")
    again = firsts.where("places > 1").select(fresh_key("around").alias("a_"), "at")
    later = matched.withColumn("a_", fresh_key("around")).join(again, "a_").where("key_ <> at.key_ or low > at.low")
    later = later.withColumn("apart", F.expr(f"key_ <> at.key_ or low >= at.low + {least}"))
    later = staged(later.select("key_", "low", "n", "mixed", "apart"), "line-later")
    unstage(matched)
    # different surroundings of one fingerprint: the first place of each is extended by windows
    open_ = firsts.where("mixed").select("at.key_", "at.low", "n").union(later.where("mixed and not apart").select("key_", "low", "n"))
    wanted = staged(open_.groupBy("key_").agg(F.collect_set(F.struct("low", "n")).alias("runs")), "line-wanted")
    near = Membership(wanted, F.col("key_")).mark(keyed, F.col("key_"), "hit_").where("hit_").drop("hit_")
    each = staged(extended_windows(near, wanted.withColumn("least", F.lit(least))), "line-windows")
    heads = each.groupBy("whole").agg(F.min(F.struct("doc_id", "key_", "first")).alias("at"), F.count("*").alias("places")).where("places > 1").select(fresh_key("whole").alias("w_"), "at")
    repeats = each.withColumn("w_", fresh_key("whole")).join(heads, "w_").where(f"key_ <> at.key_ or first >= at.first + {least}")
    spans = repeats.select("key_", "first", (F.col("first") + (least - 1)).alias("last"))
    spans = spans.union(later.where("apart").select("key_", "low", F.expr(f"low + n + {least - 2}")))
    out = staged(spans.groupBy("key_").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "line-spans")
    unstage(firsts, later, wanted, each)
    return out


_WORD = re.compile(WORD)


def merged_spans(spans: list[dict]) -> list[dict]:
    """Spans in order, those that touch joined."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def without_words(text: str, spans: list[dict]) -> tuple[str, int]:
    """The text without its words in ``spans`` (merged), and how many lines went as wholes. Lines of which
    words stay keep them; blank lines inside a span go."""
    out, at, k, gone = [], 0, 0, 0
    for line in text.split("\n"):
        words = [m.span() for m in _WORD.finditer(line)]
        while k < len(spans) and spans[k]["last"] < at:
            k += 1
        if not words:
            if k < len(spans) and spans[k]["first"] < at <= spans[k]["last"]:
                gone += 1
            else:
                out.append(line)
            continue
        pieces, low, j = [], 0, k  # low: the first word of the line that has not been dealt with
        while j < len(spans) and spans[j]["first"] < at + len(words):
            high = max(spans[j]["first"] - at, low)
            if high > low:
                pieces.append(line[words[low][0] if low else 0 : words[high - 1][1]])
            low = min(spans[j]["last"] + 1 - at, len(words))
            j += 1
        if low < len(words):
            pieces.append(line[words[low][0] if low else 0 :])
        at += len(words)
        if pieces:
            out.append(" ".join(pieces))
        else:
            gone += 1
    return "\n".join(out), gone


def dedup_passages(docs: DataFrame, least: int = LEAST_WORDS, counts: bool = True) -> DataFrame:
    """``docs`` with later repeats of ``least`` words and more taken out of ``text``, wherever in a line they start or end;
    n_chars, if there, follows.

    ``counts`` adds n_lines (of the original text), removed_lines (gone as wholes) and removed (merged spans of word
    numbers); columns of these names are replaced.
    """
    if counts:
        docs = docs.drop("n_lines", "removed_lines", "removed")
    cols = docs.columns
    found = repeated_passages(docs, least)
    packed = docs.select(F.struct(*cols).alias("doc"), F.xxhash64("doc_id", "text").alias("key_"))
    # the document travels as one struct, so that its own column names can't clash; only texts that may change are shuffled
    marked = Membership(found, F.col("key_")).mark(packed, F.col("key_"), "hit_")
    changed = marked.where("hit_").join(found, "key_", "left")
    joined = changed.unionByName(marked.where("not hit_").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("removed_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))] if counts else []
    schema = T.StructType([*docs.schema.fields, *extra])
    text_at, chars_at = cols.index("text"), cols.index("n_chars") if "n_chars" in cols else None
    pairs = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, STEP):
                batch = big.slice(low, STEP)
                out = list(batch.columns[: len(cols)])
                texts, cut = out[text_at].to_pylist(), batch.column(len(cols)).to_pylist()
                chars = out[chars_at].to_pylist() if chars_at is not None else None
                n_lines = [0 if t is None else t.count("\n") + 1 for t in texts]
                removed, gone = [[] for _ in texts], [0] * len(texts)
                for i, c in enumerate(cut):
                    if c:
                        removed[i] = merged_spans(c)
                        texts[i], gone[i] = without_words(texts[i], removed[i])
                        if chars is not None:
                            chars[i] = len(texts[i])
                out[text_at] = pa.array(texts, pa.string())
                if chars is not None:
                    out[chars_at] = pa.array(chars, out[chars_at].type)
                names = list(cols)
                if counts:
                    out += [pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pairs)]
                    names += ["n_lines", "removed_lines", "removed"]
                yield pa.RecordBatch.from_arrays(out, names)

    return joined.select(*(F.col("doc")[c].alias(c) for c in cols), F.col("spans").alias("claimgraph_spans")).mapInArrow(run, schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
