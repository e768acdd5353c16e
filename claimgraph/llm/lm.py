"""Operator 2: language-model scores by cross-entropy difference (Moore and Lewis, 2010).

Two word-bigram models are counted over the whole corpus: a target model over the documents labelled good
and clean, and a background model over all documents. They are matched: one vocabulary, one order, one
smoothing. A document's score is the mean over its words of target loss minus background loss; low scores
look like the target.

All words and bigrams count, with their exact numbers. Unigrams take what absolute discounting leaves of the bigrams. A document's own words
are taken out of the counts before it is scored, so that no document vouches for itself (the discounted mass of a word before stays that of all).

So a bigram or word that stands in one document alone counts nothing there, and only those of two documents and more are kept; the mass that a
word before passes on needs the number of its distinct bigrams, which is the number of its (document, bigram) less what the kept ones repeat.

Texts are dealt in chunks of some megabytes. A chunk asks for its bigrams, with what it counted itself, in COUNT_PARTS parts of the words before, one part's
shuffle at a time; a bucket of bigrams sums what came and answers every chunk with the numbers of those it asked for that are kept. The most frequent words, of a
fixed number, are sent to all tasks, the others are asked for in the same way. A chunk then meets its answers, and its documents are scored in one place. A
distinct bigram of a chunk is shuffled twice at most, so what is shuffled grows with the corpus and no faster.

Cases: null or empty texts and texts without words have 0 words and a null score; without labelled
documents all scores are 0 (the target model falls back to the background); labels of unknown or null
ids count for nothing, several labels of one id count by their least quality and greatest
toxicity; repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, scratch, staged, unstage
from .words import mix64, text_bytes, word_hashes, word_spans

DISCOUNT, ADD = 0.75, 0.5
STEP = 400
COUNT_PARTS = 2
#: Bytes of the texts of a chunk, without the last one.
CHUNK = 1 << 24
#: Rows of a bucket of counted bigrams (13 MB).
BUCKET = 1 << 18
#: The most words that are sent to all tasks (42 MB), and the bits of the filter of the others (16 MB).
SENT_WORDS, FILTER_BITS = 1 << 20, 27
#: Stands before the first word of a text.
START = np.uint64(0x5851F42D4C957F2D)


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good (quality 1) and clean (toxic 0)."""
    per = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return per.where("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values, offsets = text_bytes(column)
    starts, ends, first = word_spans(values, offsets)
    return word_hashes(values, starts, ends), first


def _pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) * np.uint64(0xD6E8FEB86659FD93) + word)


def _in_part(before: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Whether a word before is in the part: by the low bits of its hash (``parts`` is a power of two)."""
    return before & np.uint64(parts - 1) == np.uint64(part)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of one row of each key, in order of the keys, and the columns' sums over its rows."""
    order = np.argsort(keys)
    runs = _runs(keys[order])
    return order[runs], [np.add.reduceat(c[order], runs) if len(runs) else c for c in columns]


def _positions(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of every word of the texts: its text, the word's id and that of the word before; then the hash of each id (0 stands before the first
    word of a text) and the number of words of each text."""
    hashes, first = _words(column)
    n = np.diff(first)
    codes, words = pd.factorize(hashes)
    ids = codes.astype(np.int64) + 1
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1][n > 0]] = 0
    return np.repeat(np.arange(len(n)), n), ids, before, np.concatenate([np.array([START]), words]), n


def _document_pairs(row: np.ndarray, before: np.ndarray, ids: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    """Each text's distinct bigrams, in order of these: text, ids of the word before and of the word, and how often the text has it."""
    pairs, own = np.unique((row * wide + before) * wide + ids, return_counts=True)
    at = pairs // wide
    of = at // wide
    return of, at - of * wide, pairs - at * wide, own


def _part_pairs(column: pa.Array, part: int, parts: int) -> tuple[np.ndarray, ...]:
    """Each text's distinct bigrams whose word before is in ``part``: text, hashes of both words, and how often the text has it; no more of the text
    than the part is counted."""
    hashes, first = _words(column)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[first[:-1][n > 0]] = START
    mine = np.flatnonzero(_in_part(before, part, parts))
    row, before, word = row[mine], before[mine], hashes[mine]
    index, (own,) = _sums(mix64(_pair_hashes(before, word) + row.astype(np.uint64)), [np.ones(len(row), np.int64)])
    return row[index], before[index], word[index], own


def marked_documents(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """chunk, no, doc_id, text, is_target, staged; a chunk's rows are written behind each other, by their number ``no``. The labels grow with the documents: joined by a merge at every
    size, never broadcast."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, passed, rows = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            ends = passed + np.cumsum(np.diff(text_bytes(batch.column(1))[1]))
            begin = np.append(passed, ends[:-1])
            passed = int(ends[-1]) if len(ends) else passed
            chunk, no = first + begin[: len(ends)] // CHUNK, rows + np.arange(len(ends))
            rows += len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.astype(np.int64)), pa.array(no), *batch.columns], ["chunk", "no", "doc_id", "text", "is_target"])

    marked = docs.select("doc_id", "text").join(targets.withColumn("is_target", F.lit(True)).hint("merge"), "doc_id", "left")
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    return staged(marked.mapInArrow(deal, "chunk long, no long, doc_id long, text string, is_target boolean"), "lm-documents")


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows with the chunk first, as (chunk, its rows in small batches). A chunk whose file was cut comes in pieces, which ask apart."""
    last, held = None, []
    for whole in batches:
        chunks = whole.column(0).to_numpy()
        cuts = np.append(_runs(chunks), len(chunks)) if len(chunks) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and chunks[a] != last:
                yield last, held
                held = []
            last = int(chunks[a])
            held += [whole.slice(k, min(STEP, b - k)) for k in range(a, b, STEP)]
    if held:
        yield last, held


def _packed(columns: list[np.ndarray], cuts: np.ndarray) -> pa.Array:
    """Columns of 8-byte numbers cut at ``cuts``, one value for each piece."""
    return pa.array([np.concatenate([c[a:b].view(np.int64) for c in columns]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array, wide: int) -> list[np.ndarray]:
    """The ``wide`` columns of each packed value."""
    return [np.frombuffer(c.as_buffer(), np.int64).reshape(wide, -1) for c in column]


def _small(columns: list[np.ndarray]) -> bytes:
    """Columns of counts in as few bytes each as the greatest needs, which the first byte tells."""
    top = max(int(c.max()) for c in columns)
    size = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)
    return bytes([size]) + b"".join(c.astype(f"u{size}").tobytes() for c in columns)


def _from_small(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).reshape(2, -1).astype(np.int64)


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)


def bucket_bits(rows: int) -> int:
    """So many high bits of a hash name its bucket that a bucket has some BUCKET of ``rows``, whatever the corpus' size."""
    return max(0, (rows // BUCKET).bit_length())


ANSWERS = "chunk long, kind int, low long, bucket long, packed binary"
#: Kinds of answers: for no chunk, what a bucket's bigrams repeat (word, r0, r1); to a chunk, words (hash, w0, w1, c0, c1, p0, p1), and n0 and n1 of the bigrams of part k (PAIRS + k),
#: in the order of what the piece that begins with row ``low`` asked for.
AGAIN, WORDS, PAIRS = 0, 1, 2


def _answers(kind: int, chunk: pa.Array, low: pa.Array, bucket: pa.Array, packed: list[bytes]) -> pa.Table:
    return pa.table([chunk, pa.array(np.full(len(packed), kind, np.int32)), low, bucket, pa.array(packed, pa.binary())], ["chunk", "kind", "low", "bucket", "packed"])


def count_bigrams(marked: DataFrame, rows: int, part: int = 0, parts: int = 1, least: int = 2) -> DataFrame:
    """Answers: to each chunk the occurrences, in all texts (n0) and in the target ones (n1), of its bigrams whose word before is in ``part``, 0 where fewer than
    ``least`` texts hold them; and by the word before, how often such bigrams stand in one more text than the first, in all texts (r0) and in the target ones (r1).

    What the chunks counted goes out in buckets of the bigram's hash, each packed; ``rows`` is the number of (text, distinct bigram) of the part. A bigram
    stands in its bucket once for each chunk that has it."""
    bits = bucket_bits(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in _by_chunk(batches):
            held, low = [], texts[0].column(1)[0].as_py()
            for batch in texts:
                row, before, word, own = _part_pairs(batch.column(2), part, parts)
                held.append((before, _pair_hashes(before, word), own, np.array(batch.column(3).to_pylist(), bool)[row]))
            before, pair, own, good = (np.concatenate([h[k] for h in held]) for k in range(4))
            index, sums = _sums(pair, [own, own * good, np.ones(len(own), np.int64), good.astype(np.int64)])
            if not len(index):
                continue
            columns = [before[index], pair[index], *sums]
            bucket = _buckets(columns[1], bits)
            runs = np.append(_runs(bucket), len(bucket))
            for k in range(0, len(runs) - 1, 64):
                cuts = runs[k : k + 65]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, chunk)), pa.array(np.full(len(cuts) - 1, low)), _packed(columns, cuts)], ["bucket", "chunk", "low", "counts"])

    def answer(bucket: pa.Table) -> pa.Table:
        asked = _unpacked(bucket.column("counts"), 6)
        ends = np.cumsum([0, *(a.shape[1] for a in asked)])
        before, pair, *counts = np.concatenate(asked, axis=1)
        pair = pair.view(np.uint64)
        order = np.argsort(pair)
        runs = _runs(pair[order])
        n0, n1, d0, d1 = (np.add.reduceat(c[order], runs) for c in counts)
        run = np.empty(len(order), np.int64)
        run[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
        few = d0 < least
        n0[few] = n1[few] = 0
        packed = [_small([n0[run[a:b]], n1[run[a:b]]]) for a, b in zip(ends[:-1], ends[1:])]
        told = _answers(PAIRS + part, *(bucket.column(c).combine_chunks() for c in ("chunk", "low", "bucket")), packed)
        kept = np.flatnonzero(~few)
        if not len(kept):
            return told
        index, sums = _sums(before[order[runs[kept]]], [d0[kept] - 1, np.maximum(d1[kept] - 1, 0)])
        of = before[order[runs[kept]]][index]
        none = pa.nulls(1, pa.int64())
        return pa.concat_tables([told, _answers(AGAIN, none, none, none, [np.concatenate([of, *sums]).tobytes()])])

    asked = marked.select("chunk", "no", "text", "is_target").mapInArrow(ask, "bucket long, chunk long, low long, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, ANSWERS)


def repeated(answers: DataFrame) -> DataFrame:
    """(word, r0, r1) out of the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, r0, r1 in _unpacked(batch.column(0), 3):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(r0), pa.array(r1)], ["word", "r0", "r1"])

    rows = answers.where(F.col("kind") == AGAIN).select("packed").mapInArrow(run, "word long, r0 long, r1 long")
    return rows.groupBy("word").agg(F.sum("r0").alias("r0"), F.sum("r1").alias("r1"))


def count_words(marked: DataFrame) -> DataFrame:
    """(word, w0, w1, c0, c1, i0, i1, texts): of every word and the start of a text, occurrences as a word (w) and as the word before (c), and
    numbers of (text, distinct bigram after it) (i), in all texts (0) and in the target ones (1); ``texts`` holds it at all."""
    names = ["w0", "w1", "c0", "c1", "i0", "i1", "texts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def summed() -> pa.RecordBatch:
            word, *counts = (np.concatenate([h[k] for h in held]) for k in range(8))
            index, sums = _sums(word, counts)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (word[index].view(np.int64), *sums)], ["word", *names])

        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                row, ids, before, table, n = _positions(batch.column(0))
                wide = len(table)
                good = np.array(batch.column(1).to_pylist(), bool)
                total = lambda where, x=None: np.bincount(where, x, wide).astype(np.int64)  # noqa: E731, B023
                texts = total(np.unique(row * wide + ids) % wide)
                texts[0] = np.count_nonzero(n)
                sums = [total(ids), total(ids, good[row]), total(before), total(before, good[row])]
                row, before, _, _ = _document_pairs(row, before, ids, wide)
                sums += [total(before), total(before, good[row]), texts]
                held.append((table, *sums))
                rows += wide
                if rows > 2_000_000:
                    yield summed()
                    held, rows = [], 0
        if held:
            yield summed()

    counted = marked.select("text", "is_target").mapInArrow(count, "word long, " + ", ".join(f"{c} long" for c in names)).where("texts > 0")
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


class Found:
    """Places of hashes in a sorted array: a table by their high bits leads to the few that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's place, and whether it is there."""
        high = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[high].astype(np.int64), self.start[high + 1]
        left = np.flatnonzero(at < end)
        inside = np.zeros(len(hashes), bool)
        while len(left):
            here = self.keys[at[left]]
            inside[left] = here == hashes[left]
            left = left[here < hashes[left]]
            at[left] += 1
            left = left[at[left] < end[left]]
        return np.where(inside, at, 0), inside


class Models:
    """What is sent to all tasks: the most frequent words with their counts, and a filter of the others."""

    def __init__(self, words: np.ndarray, columns: list[np.ndarray], others: np.ndarray, total: tuple[int, int], n_words: int):
        """words: sorted; columns: of the words, w0, w1, c0, c1 and the mass that each passes on as the word before, p0, p1."""
        self.words, self.columns, self.others = words, columns, others
        self.total, self.wide = total, n_words + 2
        self.found: Found | None = None

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.found is None:  # made by each worker, not sent
            self.found = Found(self.words)
        return self.found.places(words)

    def lacking(self, words: np.ndarray) -> np.ndarray:
        """Which may be in the models but weren't sent."""
        return ~self.places(words)[1] & in_filter(self.others, words)

    def score(self, column: pa.Array, good: np.ndarray, words: tuple[Found, np.ndarray], pairs: tuple[Found, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The texts' numbers of words and their summed losses under both models; words and pairs: what the chunk was answered."""
        row, ids, before, table, n = _positions(column)
        values = [np.zeros(len(table)) for _ in range(4)] + [np.ones(len(table)) for _ in range(2)]
        for (at, inside), columns in ((self.places(table), self.columns), (words[0].places(table), [*words[1][:4], *(x.view(float) for x in words[1][4:])])):
            for value, known in zip(values, columns):
                value[inside] = known[at[inside]]
        of_text, times = np.unique(row * len(table) + ids, return_counts=True)
        row, before, word, own = _document_pairs(row, before, ids, len(table))
        own_word = times[np.searchsorted(of_text, row * len(table) + word)]
        # all that follows a word before in its text is here, in a run
        runs = _runs(row * len(table) + before)
        own_before = np.repeat(np.add.reduceat(own, runs) if len(runs) else own, np.diff(np.append(runs, len(own))))
        at, inside = pairs[0].places(_pair_hashes(table[before], table[word]))
        sums = []
        for m in (0, 1):
            k = m if self.total[1] else 0  # no target text: both models are the background
            taken = np.ones(len(row)) if k == 0 else good[row].astype(float)
            one = (np.maximum(values[k][word] - taken * own_word, 0) + ADD) / (np.maximum(self.total[k] - taken * n[row], 0) + ADD * self.wide)
            contexts = values[2 + k][before] - taken * own_before
            passed = np.where(contexts > 0, values[4 + k][before], 1)
            number = np.zeros(len(row))
            number[inside] = pairs[1][k][at[inside]]
            two = np.maximum(number - taken * own - DISCOUNT, 0) / np.maximum(contexts, 1)
            loss = -np.log(np.minimum(two, 1 - 1e-9) + np.maximum(passed, 1e-3) * one)
            sums.append(np.bincount(row, own * loss, len(n)).astype(float))
        return n, sums


def answer_words(marked: DataFrame, models, words: DataFrame, rows: int) -> DataFrame:
    """Answers: to each chunk its words that are in ``words``, of ``rows`` rows, which weren't sent. ``models`` is broadcast."""
    bits = bucket_bits(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in _by_chunk(batches):
            every = np.unique(np.concatenate([np.array([START]), *(np.unique(_words(batch.column(1))[0]) for batch in texts)]))
            every = every[models.value.lacking(every)]
            if len(every):
                bucket = _buckets(every, bits)
                cuts = np.append(_runs(bucket), len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, chunk)), _packed([every], cuts)], ["bucket", "chunk", "words"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            none = pa.array([], pa.int64())
            return _answers(WORDS, none, none, none, [])
        columns = [known.column(k).to_numpy() for k in range(1, 8)]
        order = np.argsort(columns[0].view(np.uint64))
        found = Found(columns[0].view(np.uint64)[order])
        packed = []
        for (wanted,) in _unpacked(asked.column("words"), 1):
            at, inside = found.places(wanted.view(np.uint64))
            packed.append(np.concatenate([c[order[at[inside]]].view(np.int64) for c in columns]).tobytes())
        return _answers(WORDS, asked.column("chunk").combine_chunks(), pa.nulls(len(packed), pa.int64()), asked.column("bucket").combine_chunks(), packed)

    asked = marked.select("chunk", "text").mapInArrow(ask, "bucket long, chunk long, words binary")
    known = words.select(F.shiftrightunsigned(F.shiftrightunsigned("word", 1), 63 - bits).alias("bucket"), "word", "w0", "w1", "c0", "c1", "p0", "p1")
    return asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, ANSWERS)


def answered_words(told: pa.Table) -> tuple[Found, np.ndarray]:
    """A chunk's words that were answered: their hashes, to be found, and the columns after them."""
    own = told.filter(pa.array(told.column("kind").to_numpy() == WORDS))
    columns = np.concatenate([np.zeros((7, 0), np.int64), *_unpacked(own.column("packed"), 7)], axis=1)
    columns = columns[:, np.argsort(columns[0].view(np.uint64))]
    return Found(columns[0].view(np.uint64)), columns[1:]


def answered_pairs(texts: pa.Table, told: pa.Table) -> tuple[Found, np.ndarray]:
    """A chunk's kept bigrams: their hashes, to be found, and n0 and n1. What each piece asked for is made again from its texts, in the same order, and meets the answers."""
    held = []
    for batch in texts.select(["text"]).to_batches(max_chunksize=STEP):
        word, first = _words(batch.column(0))
        n = np.diff(first)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first[:-1][n > 0]] = START
        held.append((before, _pair_hashes(before, word), n))
    before, pair, n = (np.concatenate([h[k] for h in held]) for k in range(3))
    begin, no = np.append(0, np.cumsum(n)), texts.column("no").to_numpy()
    kind, low, bucket = (told.column(c).fill_null(0).to_numpy() for c in ("kind", "low", "bucket"))
    packed = told.column("packed")
    out = [np.zeros((3, 0), np.int64)]
    for own in np.unique(kind[kind >= PAIRS]):
        lows = np.unique(low[kind == own])
        rows = np.append(np.searchsorted(no, lows), len(no))
        for first, a, b in zip(lows, begin[rows[:-1]], begin[rows[1:]]):
            mine = np.flatnonzero((kind == own) & (low == first))
            counts = np.concatenate([_from_small(packed[int(k)].as_py()) for k in mine[np.argsort(bucket[mine])]], axis=1)
            asked = np.unique(pair[a:b][_in_part(before[a:b], own - PAIRS, COUNT_PARTS)])
            if len(asked) != counts.shape[1]:
                raise ValueError(f"{len(asked)} bigrams asked for, {counts.shape[1]} answered")
            kept = counts[0] > 0
            out.append(np.concatenate([asked[kept].view(np.int64)[None], counts[:, kept]]))
    columns = np.concatenate(out, axis=1)
    columns = columns[:, np.argsort(columns[0].view(np.uint64))]
    return Found(columns[0].view(np.uint64)), columns[1:]


SCORES = "doc_id long, words long, background double, target double, is_target boolean"


def score_chunks(marked: DataFrame, models, answers: DataFrame) -> DataFrame:
    """Each document's number of words and summed losses, chunk by chunk with what it was answered. ``models`` is broadcast."""
    names = [f.split()[0] for f in SCORES.split(", ")]

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows:
            texts = texts.sort_by("no")
            words, pairs = answered_words(told), answered_pairs(texts, told)
            for batch in texts.select(["doc_id", "text", "is_target"]).to_batches(max_chunksize=STEP):
                n, sums = models.value.score(batch.column(1), np.array(batch.column(2).to_pylist(), bool), words, pairs)
                out.append(pa.table([batch.column(0), pa.array(n.astype(np.int64)), *map(pa.array, sums), batch.column(2)], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())], names)

    return marked.groupBy("chunk").cogroup(answers.where("chunk is not null").groupBy("chunk")).applyInArrow(run, SCORES)


def collected(rows: DataFrame, derive, kinds: list) -> list[np.ndarray]:
    """Columns of a table of bounded size as arrays: packed by the tasks, so that the driver only puts bytes together.

    ``derive`` makes arrays of ``kinds`` out of a batch.
    """
    names = [f"c{k}" for k in range(len(kinds))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = derive([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, kinds)], names)

    packed = rows.mapInArrow(pack, ", ".join(f"{n} binary" for n in names)).collect()
    return [np.concatenate([np.zeros(0, k), *(np.frombuffer(r[n], k) for r in packed)]) for n, k in zip(names, kinds)]


def _sorted_by_first(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in the order of the first, one copied at a time."""
    order = np.argsort(arrays[0])
    for k in range(len(arrays)):
        arrays[k] = arrays[k][order]
    return arrays


def least_sent(counts: DataFrame, column: str, most: int) -> int:
    """The least value of ``column`` from which on at most ``most`` rows remain, by a histogram of binary magnitudes in eighths."""
    step = F.floor(F.log2(F.col(column).cast("double")) * 8)
    sizes = dict(counts.where(F.col(column) > 0).groupBy(step.alias("step")).agg(F.count("*")).collect())  # some 300 rows at most
    left = 0
    for at in sorted(sizes, reverse=True):
        if left + sizes[at] > most:
            return int(2 ** ((at + 1) / 8)) + 1
        left += sizes[at]
    return 1


def score_documents(docs: DataFrame, labels: DataFrame, sent: tuple[int, ...] = (SENT_WORDS,), filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score (their difference), is_target. ``sent`` begins with the most words that are sent; bigrams no longer are."""
    spark = docs.sparkSession
    marked = marked_documents(docs, target_ids(labels))
    every = staged(count_words(marked), "lm-words")
    n_words, *total, rows = every.agg(F.count_if(F.col("w0") > 0), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("w0", "w1", "i0"))).first()
    parts = [staged(count_bigrams(marked, rows // COUNT_PARTS, part, COUNT_PARTS), "lm-pairs") for part in range(COUNT_PARTS)]
    answers = reduce(DataFrame.union, parts)
    # distinct bigrams after a word: its (text, bigram) less the repetitions of those of two texts and more; each leaves DISCOUNT
    words = every.where("texts > 1").join(repeated(answers), "word", "left")
    mass = [F.when(F.col(f"c{m}") > 0, DISCOUNT * (F.col(f"i{m}") - F.coalesce(f"r{m}", F.lit(0))) / F.col(f"c{m}")).otherwise(1.0).alias(f"p{m}") for m in (0, 1)]
    words = staged(words.select("word", "w0", "w1", "c0", "c1", *mass), "lm-models")

    often = F.greatest("w0", "c0")
    least_word = least_sent(words.select(often.alias("n")), "n", sent[0])
    number = np.int32 if total[0] < 1 << 31 else np.int64
    word, *columns = _sorted_by_first(collected(words.where(often >= least_word), lambda c: [c[0].view(np.uint64), *c[1:]], [np.uint64, *[number] * 4, float, float]))
    others = words.where(often < least_word)
    word_filter = bit_filter(others.select("word"), lambda c: c[0].view(np.uint64), filter_bits)
    shared = spark.sparkContext.broadcast(Models(word, columns, word_filter, tuple(total), n_words))

    told = staged(answer_words(marked, shared, others, others.count()), "lm-told")
    sums = score_chunks(marked, shared, answers.union(told))
    mean = [F.when(F.col("words") > 0, F.col(c) / F.col("words")).alias(f"loss_{c}") for c in ("target", "background")]
    each = sums.select("doc_id", F.col("words").alias("n_words"), *mean, "is_target")
    out = staged(each.select("doc_id", "n_words", "loss_target", "loss_background", (F.col("loss_target") - F.col("loss_background")).alias("score"), "is_target"), "lm-scores")
    unstage(marked, every, words, told, *parts)
    return out


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        return keep(score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")), "lm-result")
