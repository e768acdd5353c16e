"""Operator 9: language identification with a multilingual mixture.

Each language has a smoothed model of byte trigrams, counted over all labelled training texts into
2^16 hashed buckets. A document is a mixture: every word comes from one of the languages, with the
document's proportions. Expectation-maximisation estimates the proportions from the words' trigram likelihoods,
and the set of languages is grown while the penalised likelihood improves.

Cases: a null text, or one without any letter, is ``und`` with score 0; rows with a null language or
doc_id aren't learned from; with no labelled row at all every text is ``und``; ties go to the language
that sorts first; repeated rows give repeated rows; other columns are ignored. The broadcast
model has 2^16 numbers per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import text_bytes

BITS = 16
#: Gain in log-likelihood that one more language must bring: PENALTY * log(words + 1), and its least share of words.
PENALTY, LEAST_SHARE = 4.0, 0.1
#: Texts handled at once by a task; bounds its memory.
STEP = 400
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in range(26):
    _FOLD[[65 + _c, 97 + _c]] = 97 + _c


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trigrams(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all letter bytes, and the bucket of the trigram around each; texts don't touch."""
    folded = _FOLD[values]
    letters = np.flatnonzero(folded != 0x20)
    if not len(letters):
        return letters, np.zeros(0, np.int64)
    before, after = np.empty_like(folded), np.empty_like(folded)
    before[0], before[1:] = 0x20, folded[:-1]
    after[-1], after[:-1] = 0x20, folded[1:]
    before[offsets[:-1][offsets[:-1] < len(values)]] = 0x20
    after[offsets[1:][offsets[1:] > 0] - 1] = 0x20
    packed = (before[letters].astype(np.uint32) << 16) | (folded[letters].astype(np.uint32) << 8) | after[letters]
    return letters, (packed * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The learned languages and their log probabilities (2^16, languages), from all labelled texts outside the held-out rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                values, offsets = text_bytes(batch.column(0))
                places, buckets = trigrams(values, offsets)
                names = np.array(batch.column(1).to_pylist(), dtype=object)
                first = np.searchsorted(places, offsets)
                for name in sorted(set(names)):
                    rows = np.flatnonzero(names == name)
                    own = np.zeros(len(buckets) + 1, np.int8)
                    np.add.at(own, first[rows], 1)
                    np.add.at(own, first[rows + 1], -1)
                    picked = buckets[np.cumsum(own[:-1], dtype=np.int8) > 0]
                    sums[name] = sums.get(name, 0) + np.bincount(picked, minlength=1 << BITS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.zeros((1 << BITS, len(names)))
    table[counts["bucket"], np.searchsorted(names, counts["lang"])] = counts["n"]
    return names, np.log((table + 0.5) / (table.sum(0) + 0.5 * (1 << BITS))).astype(np.float32)


def _em(loglik: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts, languages) and log-likelihood of each text; ``allowed`` marks its languages."""
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    top = loglik.max(1)
    like = np.exp(loglik - top[:, None])
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = like * share[row]
        joint /= joint.sum(1, keepdims=True) + 1e-30
        share = np.add.reduceat(joint, first[:-1], axis=0) / words[:, None]
    total = np.add.reduceat(np.log((like * share[row]).sum(1) + 1e-30) + top, first[:-1])
    return share, total


def mixtures(loglik: np.ndarray, first: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Proportions of the chosen languages for texts of one word or more; the others' are 0.

    ``loglik``: words x languages; ``first``: each text's first word (len + 1).
    """
    n, k = len(first) - 1, loglik.shape[1]
    words = np.diff(first)
    price = PENALTY * np.log(words + 1.0)
    alone = np.add.reduceat(loglik, first[:-1], axis=0)
    best = alone.argmax(1)
    share = np.zeros((n, k))
    share[np.arange(n), best] = 1
    score = alone[np.arange(n), best].astype(float)
    if k == 1:
        return share
    _, limit = _em(loglik, first, np.ones((n, k)), rounds)
    open_rows = np.flatnonzero(limit - score > price)  # elsewhere not even all languages together are worth one more
    while len(open_rows):
        lengths = words[open_rows]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(first[open_rows] - starts[:-1], lengths) + np.arange(starts[-1])
        own = loglik[at]
        gain, chosen = np.full(len(open_rows), -np.inf), np.zeros((len(open_rows), k))
        for lang in range(k):
            allowed = (share[open_rows] > 0).astype(float)
            fresh = allowed[:, lang] == 0
            allowed[:, lang] = 1
            got, total = _em(own, starts, allowed, rounds)
            better = fresh & (got[:, lang] >= LEAST_SHARE) & (total - score[open_rows] > np.maximum(gain, price[open_rows]))
            gain = np.where(better, total - score[open_rows], gain)
            chosen[better] = got[better]
        grown = np.flatnonzero(np.isfinite(gain))
        share[open_rows[grown]] = chosen[grown]
        score[open_rows[grown]] += gain[grown]
        open_rows = open_rows[grown][(share[open_rows[grown]] > 0).sum(1) < k]
    return share


def predict_batch(column: pa.Array, names: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray, list[dict]]:
    """Language, score and the chosen languages' proportions of each text."""
    n = len(column)
    langs, scores, sets = ["und"] * n, np.zeros(n), [{} for _ in range(n)]
    values, offsets = text_bytes(column)
    places, buckets = trigrams(values, offsets)
    if not names or not len(places):
        return langs, scores, sets
    new = np.empty(len(places), bool)
    new[0], new[1:] = True, np.diff(places) > 1
    inside = np.searchsorted(places, offsets[:-1])
    new[inside[inside < len(places)]] = True
    starts = np.flatnonzero(new)
    loglik = np.add.reduceat(table[buckets], starts, axis=0)
    word_first = np.searchsorted(places[starts], offsets)
    ascii_letter = np.zeros(n, bool)
    plain = np.flatnonzero(values[places] < 0x80)
    ascii_letter[np.searchsorted(offsets, places[plain], side="right") - 1] = True
    rows = np.flatnonzero(np.diff(word_first) > 0)
    rows = np.array([i for i in rows if ascii_letter[i] or any(map(str.isalpha, column[int(i)].as_py()))], int)
    for low in range(0, len(rows), 64):  # few texts at a time keep the words x languages arrays in cache
        some = rows[low : low + 64]
        lengths = (word_first[some + 1] - word_first[some]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(word_first[some] - first[:-1], lengths) + np.arange(first[-1])
        share = mixtures(loglik[at], first)
        top = share.argmax(1)
        for i, r in enumerate(some):
            langs[r], scores[r] = names[top[i]], share[i, top[i]]
            sets[r] = {names[k]: float(share[i, k]) for k in np.flatnonzero(share[i])}
    return langs, np.minimum(scores, 1.0), sets


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, proportions (map of language to share)."""
    names, table = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                langs, scores, sets = predict_batch(batch.column(1), known, logs)
                shares = pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), shares], ["doc_id", "lang_pred", "score", "proportions"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without those that have no letters or no language with two fifths of the words; all columns stay."""
    names, table = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                langs, scores, _ = predict_batch(batch.column(at), known, logs)
                yield batch.filter(pa.array([g != "und" and s >= least for g, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_sort(F.map_keys("proportions")).alias("languages"))
