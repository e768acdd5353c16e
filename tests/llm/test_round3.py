"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import centroids, embed, lm, media, mixing, near, phrases, sharding, toxicity
from claimgraph.operators import iterate
from conftest import DATA

DOCS = "doc_id long, text string, lang string, a string, w_ int, rank int"
VECTORS = "vec_id long, embedding array<float>, v int, n int, cluster int"


def brute_phrases(rows, least, longest, top):
    """Counts by hand: (lang, rank, phrase, a, l, r, n, score)."""
    f, total = {}, Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    key = ("und" if lang is None else lang, tuple(w[i : i + n]))
                    f[key] = f.get(key, 0) + 1
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or any(x == lang and len(y) > len(w) and 100 * b >= 100 * a and any(y[i : i + len(w)] == w for i in range(len(y))) for (x, y), b in f.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def test_collocations(spark):
    rng = random.Random(5)
    words = ["The", "the", "of", "æther", "x y", "zig", "a", "B", "--"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "en", "en", "fr", None, "und", ""]), "x", 1, 2) for k in range(150)]
    rows += [(1, "zig zig zig zig zig zig zig", "en", None, None, None)] * 40 + [(None, None, "en", None, None, None), (3, "", None, None, None, None), (4, " \t. ;", "fr", None, None, None), (5, "q" * 5000 + " the" * 3000, "fr", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = phrases.collocations(docs, least=20, top=30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 20, 5, 30)


def test_collocations_whatever_the_trigger(spark):
    rows = [(k, "one two three four five six, seven eight nine ten " * (k % 7), "en", "", 0, 0) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    found = []
    for trigger in (1, 3, 1 << 40):  # a chunk at each word, some, one for each piece
        chunks = phrases.dictionary(docs, trigger)
        found.append(sorted(map(tuple, phrases.count_phrases(chunks, 3).collect())))
    assert found[0] == found[1] == found[2] and found[0]


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_collocations_beyond_64_bits(spark):
    levels = [spark.createDataFrame([("en", "a", 10**12), ("en", "b", 10**12)], "lang string, phrase string, f long"), spark.createDataFrame([("en", "a b", 10**12)], "lang string, phrase string, f long")]
    (row,) = phrases.scored(levels, spark.createDataFrame([("en", 9 * 10**12 + 7)], "lang string, n long")).collect()
    assert row.score == 1000 * 10**12 * (9 * 10**12 + 7) // 10**24


def brute_clusters(rows, k, rounds, dim, scale):
    """Whole-number rounds by hand: {row index: (cluster, distance)}, centroids."""
    kept = []
    for i, (vec_id, e, *_) in enumerate(rows):
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) and abs(x) < centroids.MOST for x in e):
            kept.append((i, vec_id, [math.floor(scale * float(np.float32(x))) for x in e]))
    order = sorted(kept, key=lambda r: (r[1] is None, hashlib.sha256(f"3:{r[1]}".encode()).hexdigest() if r[1] is not None else "", r[2]))
    cents = [r[2] for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = {}
        for _, _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        for c, vs in of.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(vec_id, near(v)[1], near(v)[0]) for _, vec_id, v in kept], cents


def vector_rows(dim=6):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(3 * (k % 5), 0.3) * (-1) ** k for _ in range(dim)], 0, 0, 0) for k in range(200)]
    rows += [(500, [0.25] * dim, 0, 0, 0)] * 60 + [(None, [1.0] * dim, 0, 0, 0), (501, None, 0, 0, 0), (502, [1.0] * (dim - 1), 0, 0, 0), (503, [None] + [1.0] * (dim - 1), 0, 0, 0)]
    return rows + [(504, [float("nan")] * dim, 0, 0, 0), (505, [float("inf")] + [0.0] * (dim - 1), 0, 0, 0), (506, [], 0, 0, 0), (507, [3e30] + [0.0] * (dim - 1), 0, 0, 0), (508, [0.0] * dim, 0, 0, 0)]


@pytest.mark.parametrize("k, rounds", [(8, 10), (1, 2), (3, 0)])
def test_clusters(spark, k, rounds):
    rows = vector_rows()
    got = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), k=k, rounds=rounds, dim=6).collect()
    want, cents = brute_clusters(rows, k, rounds, 6, 1024)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_and_none(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], VECTORS), dim=6).collect() == []
    few = centroids.cluster_vectors(spark.createDataFrame(vector_rows()[:3], VECTORS), dim=6).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and {r.inertia for r in few} == {0}


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    order = np.array([int.from_bytes(k, "big") for k in centroids.hilbert_keys(cells, 4)]).argsort()
    steps = np.abs(np.diff(cells[order], axis=0)).sum(1)
    assert (steps == 1).all()


def test_boxes_keep_the_nearest():
    rng = np.random.default_rng(1)
    cents = rng.integers(-50, 50, (8, 4))
    pruned = 0
    for _ in range(50):
        m = rng.integers(-50, 50, 4) + rng.integers(-8, 8, (20, 4))
        may = centroids.candidates(m.min(0)[None], m.max(0)[None], cents)[0]
        best, distance = centroids.nearest(m, cents, np.arange(8))
        assert may[best].all()
        again = centroids.nearest(m, cents, np.flatnonzero(may))
        assert (again[0] == best).all() and (again[1] == distance).all()
        pruned += 8 - may.sum()
    assert pruned


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_is_the_distance():
    rng = random.Random(2)
    terms = ["scum", "idiot", "moron", "idiots", "worthless", "pathetic", "clown", "clowning*", "bad*", "ab"]
    automaton = toxicity.Automaton(terms)

    def broken(word):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abiost") + word[k:], word[:k] + rng.choice("abiost") + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]]) or "a"
        return word

    hits = 0
    for _ in range(3000):
        token = broken(rng.choice(terms).rstrip("*")) + rng.choice(["", "", "s", "xyz"])
        want = set()
        for t, term in enumerate(terms):
            stem, most = term.rstrip("*"), toxicity.allowed(term)
            heads = [token[:k] for k in range(1, len(token) + 1)] if term.endswith("*") else [token]
            least = min(edits(h, stem) for h in heads)
            if least == 0 or (least <= most and token[0] == stem[0]):
                want.add((least, t))
        got = automaton.match(token)
        assert (got is None) == (not want), (token, got, want)
        if got:
            assert (got[1], got[0]) in want and got[1] == min(want)[0], (token, got, want)
            hits += 1
    assert hits > 1000


TOXIC_DOCS = "doc_id long, text string, lang string, source string, term int, score double, toxic int"


def toxic_rows(n=400, seed=9):
    """Clean prose, abuse with some misspellings, and clean texts that quote a term; every third text carries a stem instead."""
    rng = random.Random(seed)
    syllables = ["ta", "ro", "mi", "ke", "lu", "so"]
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            term = rng.choice(["Gruffle", "gruflfe", "gruffl3", "wobbert", "WOBBERT!", "wobbbert"]) if k % 3 else "zonk" + rng.choice(syllables)
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), term)
        elif k % 7 == 0:
            words[2:2] = ["they", "said", '"you', 'gruffle"', "quoted"]
        rows.append((k, " ".join(words), "en", None, None, None, None))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def held_out(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_toxicity(spark):
    rows, labels = toxic_rows()
    odd = [(1000, None, None, None, None, None, None), (1001, "", "en", None, None, None, None), (None, "you gruffle", None, None, None, None, None), (1002, " \n", None, None, None, None, None), (1003, "ta ro " * 20000 + "wobbert", "en", "a", 1, 1.0, 1), (1003, "ta ro " * 20000 + "wobbert", "en", "a", 1, 1.0, 1)]
    docs = spark.createDataFrame(rows + odd, TOXIC_DOCS).repartition(3)
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (77777, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, table)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(by[k].held_out == held_out(k) for k, *_ in rows) and not by[None].held_out
    wrong = [k for k, _, t in labels if held_out(k) and by[k].predicted != t]
    assert len(wrong) <= 2, wrong
    assert by[1000].score == by[1001].score == by[1002].score and by[1000].predicted == 0
    assert by[1003].score > by[1001].score  # whole texts: a term at the end of a long one counts
    # labels of held-out rows teach nothing
    other = spark.createDataFrame([(k, q, 1 - t if held_out(k) else t) for k, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, other).collect()}
    assert all(abs(again[k] - by[k].score) < 1e-9 for k in by)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(toxic_rows(20)[0], TOXIC_DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score_documents(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.score_documents(docs.where("false"), none).collect() == []


def test_window_pairs_are_all():
    rng = np.random.default_rng(5)
    cells, cells2 = rng.integers(-3, 3, 200), rng.integers(-3, 3, 150)
    values, values2 = rng.normal(size=200), rng.normal(size=150)
    i, j = embed.window_pairs(cells, values, cells2, values2, 0.3)
    want = np.argwhere((cells[:, None] == cells2[None]) & (np.abs(values[:, None] - values2[None]) <= 0.3))
    assert {tuple(x) for x in want} <= set(zip(i.tolist(), j.tolist())) and len(i) < len(want) * 1.01 + 2
    assert len(embed.window_pairs(cells[:0], values[:0], cells2, values2, 0.3)[0]) == 0


def test_broken_files_keep_a_row(spark):
    files = spark.createDataFrame([(1, 4, bytearray(b"junk"), 4, "x"), (2, 0, None, None, None), (3, 3, bytearray(media.store(media.payload_of(b"abc"))), 9, "y")], "doc_id long, n_bytes long, media binary, media_bytes long, media_sha256 string")
    got = {r.doc_id: r for r in media.digests(media.tiff_pages(files).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "samples", "error")).collect()}
    assert set(got) == {1, 2, 3}
    for k in (1, 2):
        assert got[k].payload_sha256 is None and got[k].payload_bytes is None and got[k].feature.startswith("error=")
    assert got[3].payload_bytes == 64 and got[3].payload_sha256 == hashlib.sha256(b"abc" + bytes(61)).hexdigest() and got[3].media_sha256 == "y"


def test_queries_leave_their_result_alone(spark):
    folder = iterate.shared_folder(spark).removeprefix("file://") + "/claimgraph"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for query, left in ((mixing.op3_mixing, "mix-taken"), (sharding.op5_sharding, "shard-slots"), (embed.op7_embeddings, "embed-result"), (near.op6_ngram_jaccard, "near-classes"), (lm.op2_lm_scoring, "lm-result")):
        assert query(spark, DATA).count()
        new = set(os.listdir(folder)) - before
        assert [x.rsplit("-", 1)[0] for x in new] == [left], new
        before |= new


def test_lm_bigrams_are_answered_by_chunk(spark, monkeypatch):
    """A chunk is answered two bytes for a bigram, never a row; a chunk that was cut is answered piece by piece, with the same numbers."""
    monkeypatch.setattr(lm, "CHUNK", 4_000)
    rng = random.Random(31)
    rows = [(d, " ".join(f"w{rng.randrange(60)}" for _ in range(60)) if d % 9 else None) for d in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    marked = lm.marked_documents(d, spark.createDataFrame([(k,) for k in range(90)], "doc_id long"))
    assert marked.select("chunk").distinct().count() >= 8 and marked.count() == 200
    cut = marked.where("no % 40 < 25").union(marked.where("no % 40 >= 25"))
    for chunk in [r.chunk for r in marked.select("chunk").distinct().collect()]:
        texts = marked.where(F.col("chunk") == chunk).toArrow().sort_by("no")
        got = []
        for table in (marked, cut) if chunk % 3 == 0 else (marked,):
            answers = lm.count_bigrams(table, 1, 0, lm.COUNT_PARTS).union(lm.count_bigrams(table, 1, 1, lm.COUNT_PARTS))
            told = answers.where((F.col("chunk") == chunk) & (F.col("kind") >= lm.PAIRS)).toArrow()
            found, counts = lm.answered_pairs(texts, told)
            got.append({int(k): tuple(map(int, counts[:, i])) for i, k in enumerate(found.keys)})
        hashes = lm._part_pairs(texts.column("text"), 0, 1)
        assert sum(len(x.as_py()) - 1 for x in told.column("packed")) <= 4 * len(hashes[0])
        assert got[0] == got[-1] and all(n0 >= 2 and n1 <= n0 for n0, n1 in got[0].values())
        if chunk % 3 == 0:
            break
