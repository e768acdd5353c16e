"""The training-data operators against brute force, round trips and held-out accuracy, and in odd cases."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimgraph.llm import common, embed, language, linedup, lm, media, mixing, near, sharding, tokens, words
from conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key_ string, size int, n int, row_id int, shard string"


def low(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and then ran away", "en", "a", 40, "x", 1, 1, 1, "s"),
        (1, "the cat sat on the mat and then ran away", "en", "a", 40, "x", 1, 1, 1, "s"),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", None, 0, None, None, None, None, None),
        (4, " \n\t ", "fr", "b", 4, None, None, None, None, None),
        (5, "…\n12 345", None, "b", 8, None, None, None, None, None),
        (6, long, "en", "a", len(long), None, None, None, None, None),
        (None, "le chat et la souris sont dans la maison", "fr", "b", 40, None, None, None, None, None),
        (7, "le chat et la souris sont dans la maison", "fr", "b", 40, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_words_and_shingles():
    texts = ["Ab  c\nd", "", None, "é É", "x" * 200 + " y", "a\x0bb\x1cc"]
    values, offsets = words.text_bytes(pa.array(texts))
    starts, ends, first = words.word_spans(values, offsets)
    hashes = words.word_hashes(values, starts, ends)
    want = [[low(w) for w in WORD.findall(t or "")] for t in texts]
    assert np.diff(first).tolist() == list(map(len, want))
    by = {}
    for w, h in zip(itertools.chain(*want), hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    s, at = words.shingles(hashes, first, 2)
    assert np.diff(at).tolist() == [max(len(w) - 1, min(1, len(w))) for w in want]
    empty = words.text_bytes(pa.array([], pa.string()))
    assert words.word_spans(*empty)[2].tolist() == [0]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 100)]
    df = spark.createDataFrame(links, "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    want = {x: find(x) for x in root}
    for few in (1000, 0):
        assert {r.node: r.component for r in common.connected_components(df, few=few).collect()} == want


# 1 ------------------------------------------------------------------------------------------------
def brute_passages(rows, least):
    """The words left of each text, without those in later repeats of ``least`` words."""
    docs = [(d, [low(x) for x in WORD.findall(t or "")]) for d, t in sorted(rows)]
    seen, out = {}, {}
    for k, (d, w) in enumerate(docs):
        gone = set()
        for a in range(len(w) - least + 1):
            at = seen.setdefault(tuple(w[a : a + least]), (k, a))
            if at[0] != k or a >= at[1] + least:
                gone |= set(range(a, a + least))
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


@pytest.mark.parametrize("least", [3, 13, 50])
def test_passages_brute_force(spark, least):
    rng = random.Random(least)
    base = [f"b{i}" for i in range(4 * least)]
    rows = []
    for d in range(60):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(2 * least))]
        for _ in range(rng.randrange(3)):
            a, at = rng.randrange(3 * least), rng.randrange(len(w) + 1)
            w[at:at] = base[a : a + least + rng.randrange(-2, least)]
        rows.append((d, "".join(x + rng.choice([" ", " ", " ", "\n", "\n\n"]) for x in w)))
    got = {r.doc_id: r for r in linedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least).collect()}
    want = brute_passages(rows, least)
    assert {d: WORD.findall(r.text.lower()) for d, r in got.items()} == want
    assert all(sum(s.last - s.first + 1 for s in r.removed) == len(WORD.findall(rows[d][1])) - len(want[d]) for d, r in got.items())


def test_passages_inside_lines(spark, odd):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"one {passage} two", 0), (2, f"three {passage.upper()} four\n \nfive", 0), (3, f"six\n{passage}\nseven", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in linedup.dedup_passages(d).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("three four\n \nfive", 17), 3: ("six\nseven", 9)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, d, DATA).collect()}[2] == "three four\n \nfive"
    out = linedup.dedup_passages(odd, counts=False)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where("doc_id = 2").first().text is None
    assert linedup.dedup_passages(odd.limit(0)).count() == 0


# 2 ------------------------------------------------------------------------------------------------
def test_lm_scoring(spark, docs, odd):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["delta", "eps", "zeta"]) for _ in range(30)) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    s = {r.doc_id: r for r in lm.score_documents(d, labels).collect()}
    assert max(s[i].score for i in range(60)) < min(s[i].score for i in range(60, 120))
    assert s[0].is_target and not s[40].is_target and s[0].n_words == 30
    out = {r.doc_id: r for r in lm.score_documents(odd, labels).collect()}
    assert out[2].n_words == 0 and out[2].score is None and out[4].score is None and out[6].n_words == 30_000
    assert lm.score_documents(odd, labels.limit(0)).agg(F.max(F.abs("score"))).first()[0] == 0
    assert lm.score_documents(odd.limit(0), labels).count() == 0


def brute_scores(rows, targets):
    texts = [[low(x) for x in WORD.findall(t or "")] for _, t in rows]
    bigrams = [list(zip([None, *w], w)) for w in texts]
    good = [d in targets for d, _ in rows]
    models = []
    for m in (0, 1):
        n = Counter(x for b, g in zip(bigrams, good) if g or not m for x in b)
        words_, contexts, kept = Counter(), Counter(), Counter()
        for (b, w), c in n.items():
            words_[w] += c
            contexts[b] += c
            kept[b] += c - lm.DISCOUNT
        models.append((n, words_, contexts, kept, sum(n.values())))
    wide = len(models[0][1]) + 2
    out = []
    for b, g in zip(bigrams, good):
        pair, word, before, loss = Counter(b), Counter(w for _, w in b), Counter(x for x, _ in b), [0.0, 0.0]
        for m, (n, words_, contexts, kept, total) in enumerate(models):
            own = g or not m
            for x, w in b:
                one = (max(words_[w] - own * word[w], 0) + lm.ADD) / (total - own * len(b) + lm.ADD * wide)
                c = contexts[x] - own * before[x]
                two = max(n[x, w] - own * pair[x, w] - lm.DISCOUNT, 0) / max(c, 1)
                passed = 1 - kept[x] / max(contexts[x], 1) if c > 0 else 1
                loss[m] -= np.log(min(two, 1 - 1e-9) + max(passed, 1e-3) * one)
        out.append((len(b), *(x / len(b) if b else None for x in loss)))
    return out


@pytest.mark.parametrize("sent, bits", [((0, 0), 8), ((0, 0), 27), ((3, 2), 16), ((1 << 20, 4), 27), ((40, 1 << 21), 27), ((1 << 20, 1 << 21), 27)])
def test_lm_counts_all_words(spark, sent, bits):
    """All words and bigrams count as they do by hand, whatever is sent and whatever is joined, with filters that let everything pass too; rows alike stay rows."""
    rng = random.Random(22)
    rows = [(d, " ".join(rng.choice(["rare", "seldom", "scarce", "few"]) for _ in range(rng.randrange(9)))) for d in range(40)]
    rows += [(40, " ".join(f"w{rng.randrange(3_000)}" for _ in range(20_000))), (43, " ".join(f"w{rng.randrange(3_000)}" for _ in range(9_000))), (41, None), (3, rows[3][1]), (None, "rare few")]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(0, 40, 2), 43]], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.loss_background, r.loss_target) for r in lm.score_documents(d, labels, sent, bits).collect()), key=str)
    want = sorted(((k is None, k or 0, *x) for (k, _), x in zip(rows, brute_scores(rows, {*range(0, 40, 2), 43}))), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for a, b in zip(got, want):
        assert (a[3] is None) == (b[3] is None) and (a[3] is None or a[3:] == pytest.approx(b[3:], rel=1e-9))


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    one, many = ({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n), labels).collect()} for n in (1, 16))
    assert one == pytest.approx(many, rel=1e-9) and len(one) == docs.count()
    want = brute_scores([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in lm.target_ids(labels).collect()})
    assert [one[r.doc_id] for r in docs.collect()] == pytest.approx([x[2] - x[1] for x in want], rel=1e-6, abs=1e-9)


# 3 ------------------------------------------------------------------------------------------------
def fill(sizes, weights, most=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        rest = total - sum(most * s for i, s in enumerate(sizes) if i not in open_)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        for i in open_:
            target[i] = most * sizes[i] if i in over else share[i]
        if not over:
            break
        open_ -= over
    return target


def test_mixing_targets(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 5, 50, 400, 3000]) for _ in range(17)]
    df = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
    assert np.allclose(got, fill(sizes, [(5, 2, 1)[i % 3] for i in range(17)]))


def test_mixing(spark, docs, odd):
    out = mixing.op3_mixing(spark, DATA).toPandas()
    again = mixing.op3_mixing(spark, DATA).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    assert len(out) == docs.count() and (out.taken <= 3 * out["size"]).all()
    of = out.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(of.taken - of.target) <= 1).all()
    draws = mixing.mix(docs).where("words > 0")
    blocks = draws.groupBy("source_size", "target", "block").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0]
    assert blocks == 1
    o = {(r.doc_id, r.size): r.taken for r in mixing.mix(odd).groupBy("doc_id", "row_id", "size").agg(F.sum("words").alias("taken")).collect()}
    assert o[(2, 0)] == 0 and o[(4, 0)] == 0
    piece = mixing.mix(docs).where("words > 0").groupBy("row_id", "epoch").agg(F.count("*").alias("n"), F.max("block").alias("b"), F.min("block").alias("a"), F.sum("words").alias("w"), F.first("size").alias("size"))
    assert piece.where("n <> b - a + 1 or w > size").count() == 0 and piece.where("n > 1").count() > 0  # long texts reach over blocks
    shards = mixing.mixed_documents(docs, "shard").groupBy("shard").count().toPandas()
    assert set(shards["shard"]) <= set(range(16)) and len(shards) > 8
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.where("doc_id in (2, 3, 4)").count() == 0
    assert mixing.mix(odd.limit(0)).count() == 0


def test_splitting_tree(spark):
    q = spark.createDataFrame([(0, 37), (1, 5), (2, 0), (3, 90)], "rank int, n long")
    got = mixing.split_quotas(q, 16, 7).toPandas()
    assert got.groupby("rank").n.sum().to_dict() == {0: 37, 1: 5, 2: 0, 3: 90}
    per = got.groupby("shard").n.sum()
    assert len(per) == 16 and per.max() - per.min() <= 1 and (got.n >= 0).all()


# 4 and 10 -----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


TEXTS = ["a  b", " a", "a ", "", "  ", "\n", "a\nb", "\xa0x", "ﬁ é", "</s> <s> a", "\x00a", "▁a b", "a▁b", "日本語 テ", "5 55 a5", "x²._y", "_{\\a}", "😀 😀a", "a" * 3000 + " " + "the" * 900]


def test_pieces_equal_the_library(model, docs):
    with open(model, "rb") as f:
        p = tokens.Pieces(f.read())
    texts = TEXTS + [r.text for r in docs.limit(60).collect()]
    want = p.library.encode(texts, num_threads=1)
    assert [p.encode(t).tolist() for t in texts] == want
    assert p.count_batch(texts) == list(map(len, want))
    for t, ids in zip(texts[:40], want):
        marked = (" " + t.replace("▁", " ")).replace(" ", "▁") if t else ""
        assert list(p.stream(iter(marked))) == ids == list(p.stream([marked]))
        assert p.decode(ids) == t.replace("▁", " ")


def test_token_queries(spark, model, odd):
    c = {r.doc_id: r for r in tokens.token_counts(odd, model).collect()}
    assert (c[2].n_bytes, c[2].n_tokens, c[2].over_limit) == (0, 0, False) and c[6].over_limit and c[5].n_bytes == len("…\n12 345".encode())
    e = tokens.encode_documents(odd, model).collect()
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in e) and len(e) == odd.count()
    assert {r.doc_id: r.n_tokens for r in e} == {k: r.n_tokens for k, r in c.items()}
    assert tokens.token_counts(odd.limit(0), model).count() == 0


# 5 ------------------------------------------------------------------------------------------------
def test_differencing():
    rng = random.Random(5)
    items = [rng.randrange(1, 1000) for _ in range(300)]
    slots, sums = sharding.difference([[x, 0, 0, 0] for x in items])
    got = [0] * 4
    for x, s in zip(items, slots):
        got[s[0]] += x
        assert sorted(s) == [0, 1, 2, 3]
    assert sorted(got) == sorted(sums) and max(got) - min(got) <= 5
    for i, total in enumerate(sums):
        assert got[i] == total
    assert sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])[1] == [16, 14]


def test_sharding(spark, docs, odd):
    out = sharding.op5_sharding(spark, DATA).toPandas()
    full = out.merge(docs.toPandas(), on="doc_id")
    assert all(s == len(t.encode()) + 1 and c == zlib.crc32(t.encode()) for s, c, t in zip(full["size"], full.text_crc32, full.text))
    assert full.groupby("text").shard.nunique().max() == 1 and set(out.law) == {"bytes"}
    assert all(sorted(x) == list(range(len(x))) for _, x in out.groupby("shard").slot)
    of = out.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    groups = full.groupby("text")["size"].sum()
    assert of.max() - of.min() <= max(1, int(groups.median())) or of.max() == groups.max()
    o = sharding.shard_documents(odd).collect()
    assert len(o) == odd.count() and len({r.shard for r in o if r.size == 1}) == 1
    assert sharding.shard_documents(odd.limit(0)).count() == 0
    pairs = spark.range(3000).select(F.col("id").alias("g"), (F.col("id") % 97 + 1).alias("bytes"))
    sums = sharding.shard_groups(pairs, 8, each=10).join(pairs, "g").groupBy("shard").agg(F.sum("bytes").alias("s")).toPandas()
    assert len(sums) == 8 and sums.s.max() - sums.s.min() <= 97


# 6 ------------------------------------------------------------------------------------------------
def brute_classes(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = [low(x) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("size", "percent", "families"), [(4, 85, 3), (5, 80, 3), (2, 60, 2)])
def test_jaccard_brute_force(spark, size, percent, families):
    rng = random.Random(size * percent)
    rows, vocabulary = [], [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 120]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 8, 40]))]
        rows.append((len(rows), " ".join(w + passage if rng.random() < 0.5 else w)))
    got = near.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows, size, percent)


def test_jaccard_on_documents_and_odd(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near.op6_ngram_jaccard(spark, DATA).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows, 4, 85)
    o = near.similar_classes(odd).collect()
    by = {r.doc_id: r for r in o}
    assert len(o) == odd.count() and by[2].n_shingles == 0 and by[2].component_id == 2 and by[4].component_id == 4
    assert by[7].component_id == by[None].component_id == 7  # alike but for the id
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert near.similar_classes(odd.limit(0)).count() == 0


def test_keep_one_without_ids(spark):
    """Different texts stay whatever their ids; a repeated id neither saves a near-duplicate nor loses a unique text."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"] + " more"), (1, text["c"]), (5, text["c"] + " more"), (5, text["d"]), (5, text["d"]), (None, text["c"]), (6, text["e"]), (6, "x " + text["e"]), (None, None), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near.keep_one(d).collect()
    groups = sorted(next((k for k in "abcde" if text[k] in (r.text or "")), "") for r in got)
    assert groups == ["", "", "a", "b", "c", "d", "e"]
    assert {r.doc_id for r in got if text["c"] in (r.text or "")} == {1}


# 7 ------------------------------------------------------------------------------------------------
def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 16))
    near_ = np.concatenate([base[i % 5] + 0.04 * rng.standard_normal((1, 16)) for i in range(80)])
    x = np.concatenate([base, near_, base[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0, 2.0])]
    got = {r.vec_id: r for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T >= 0.95 - 1e-12
    np.fill_diagonal(sim, False)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.98 * sim.sum()
    assert all(got[i].n_links <= sim[i].sum() for i in range(len(x)))
    assert got[380].component_id == 0 and all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert embed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embed.lists_needed() < 64


def test_embeddings_of_several_lengths_and_odd(spark):
    """Each length is compared with its own; repeated and null ids and clashing columns do no harm."""
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.01, 2.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.01]), (6, [0.0, 1.0, 0.0]), (6, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.02]), (7, []), (8, [float("inf")] * 2), (9, [3.0])]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vec string, row_ int")
    got = embed.near_vectors(d).collect()
    links = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert links == Counter([(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 2, 6), (6, 2, 6), (None, 2, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)])


# 8 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 64, 65, 5000, 262_145])
def test_tiff_round_trip(n):
    rng = random.Random(n)
    for data in (bytes(rng.choice(b"abcde \n") for _ in range(n)), bytes(n), rng.randbytes(n)):
        p = media.payload_of(data)
        assert len(p) >= 64 and len(p) % 64 == 0 and p.startswith(data)
        for kind in (media.NONE, media.DEFLATE, media.PACKBITS, media.LZW):
            for tiled, predictor in itertools.product((False, True), (1, 2)):
                assert b"".join(x.samples for x in media.read_tiff(media.write_tiff(p, kind, tiled, predictor))) == p
        assert media.store(p) == media.store(p)


def plain_tiff(end, width, height, channels, planar, strips, rows, kind=1, bits=8, **other):
    """A file as other programs write it: either byte order, several channels, chunky or planar."""
    fields = {256: [width], 257: [height], 258: [bits] * channels, 259: [kind], 262: [1], 277: [channels], 278: [rows], 279: [len(s) for s in strips], 284: [2 if planar else 1]} | {int(k[1:]): v for k, v in other.items()}
    head = 8 + 2 + 12 * (len(fields) + 1) + 4
    extra, data_at = b"", head + 400
    fields[273] = [data_at + sum(map(len, strips[:i])) for i in range(len(strips))]
    table = b""
    for tag, values in sorted(fields.items()):
        packed = struct.pack(f"{end}{len(values)}I", *values)
        if len(packed) > 4:
            packed, extra = struct.pack(end + "I", head + len(extra)), extra + packed
        table += struct.pack(end + "HHI", tag, 4, len(values)) + packed
    file = struct.pack(end + "2sHI", b"II" if end == "<" else b"MM", 42, 8) + struct.pack(end + "H", len(fields)) + table + struct.pack(end + "I", 0) + extra
    return file.ljust(data_at, b"\0") + b"".join(strips)


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("kind", [1, 5, 8, 32773])
def test_tiff_from_elsewhere(end, planar, kind):
    image = np.random.default_rng(8).integers(0, 5, (5, 7, 3), np.uint8)
    planes = [image[..., k] for k in range(3)] if planar else [image]
    strips = [media.compress(kind, p[y : y + 2].tobytes()) for p in planes for y in range(0, 5, 2)]
    page = next(media.read_tiff(plain_tiff(end, 7, 5, 3, planar, strips, 2, kind)))
    assert (page.width, page.height, page.channels) == (7, 5, 3) and page.samples == image.tobytes()


def test_tiff_hostile_files(spark):
    """Broken files give a row with their error each: no geometry, claimed size, loop or bomb ends the job."""
    good = media.write_tiff(bytes(range(64)) * 3, media.DEFLATE)
    bomb = zlib.compress(bytes(10_000_000))
    files = [
        plain_tiff("<", 0, 5, 1, False, [b"x"], 1), plain_tiff("<", 1 << 31, 1 << 31, 1, False, [b"x"], 1), plain_tiff("<", 8, 8, 1, False, [b"x"], 0), plain_tiff("<", 8, 8, 1, False, [b"short"], 8),
        plain_tiff("<", 8, 8, 1, False, [b"x" * 64] * 9, 8), plain_tiff("<", 8, 8, 1, False, [b"x" * 64], 8, bits=16), plain_tiff("<", 8, 8, 1, False, [b"x" * 64], 8, kind=99), plain_tiff("<", 8, 8, 1, False, [b"junk"], 8, kind=8),
        plain_tiff("<", 8, 8, 1, False, [b"x" * 64], 8, t322=[0], t323=[0], t324=[8], t325=[8]), good[:20], b"II*\0\x08\0\0\0",
    ]
    rng = random.Random(8)
    for _ in range(60):
        broken = bytearray(good)
        for _ in range(4):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        files.append(bytes(broken))
    files.append(plain_tiff("<", 8, 8, 1, False, [bomb], 8, kind=8))
    rows = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "id int, media binary")
    out = media.tiff_pages(rows).collect()
    first = {r.id: r for r in out if r.page == 0}
    assert sorted(first) == list(range(len(files))) and all(first[i].error and first[i].samples is None for i in range(11))
    assert bytes(first[len(files) - 1].samples) == bytes(64)  # no more of a bomb than its page needs


def test_tiff_pages_and_digests(spark, odd, docs):
    files = spark.createDataFrame([(1, bytearray(media.write_tiff(bytes(600_000), media.DEFLATE)), "p"), (2, bytearray(b"junk"), "q"), (3, None, "r")], "id long, media binary, page string")
    pages = media.tiff_pages(files).collect()
    assert [(r.id, r.page) for r in pages] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)] and pages[3].error and pages[3].samples is None
    out = {r.doc_id: r for r in media.op8_tiff(spark, DATA).collect()}
    for r in docs.collect():
        p = media.payload_of(r.text.encode())
        x = out[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(r.text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert x.media_sha256 == hashlib.sha256(media.store(p)).hexdigest() and x.media_bytes == len(media.store(p))
    stored = media.store_texts(odd)
    assert stored.where("doc_id = 2").first().n_bytes == 0 and media.tiff_pages(stored).count() == odd.count()


# 9 ------------------------------------------------------------------------------------------------
def test_language(spark, docs, odd):
    out = language.op9_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().merge(out, on="doc_id")
    held = truth[truth.held_out & truth.lang.notna()]
    assert (held.lang == held.lang_pred).mean() >= 0.98 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(out.doc_id, out.held_out))
    model = language.train(docs)
    o = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert o[2].lang_pred == o[3].lang_pred == o[4].lang_pred == o[5].lang_pred == "und" and o[2].score == 0
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 3, 4, 5)").count() == 0
    assert language.identify(odd.where("lang is null")).where("lang_pred <> 'und'").count() == 0
    assert language.identify(odd.limit(0), model).count() == 0


def test_language_mixture():
    rng = np.random.default_rng(9)
    clear = np.where(np.arange(400)[:, None] % 2 == np.arange(2), -1.0, -6.0)
    mixed = language.mixtures(clear + 0.1 * rng.standard_normal((400, 2)), np.array([0, 400]))
    assert np.allclose(mixed, 0.5, atol=0.05)
    pure = language.mixtures(np.tile([-1.0, -6.0], (400, 1)), np.array([0, 400]))
    assert pure.tolist() == [[1.0, 0.0]]


# pipeline -----------------------------------------------------------------------------------------
def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert len(out) and out.round_trip.all() and corpus_pipeline.ORACLE_SQL is None
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = common.staged(stage(spark, d, DATA), name)
        assert d.columns == docs.columns
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in d.collect()]
            assert all(c == i for i, (_, c) in brute_classes(rows, 5, 80).items())
    assert sorted(r.doc_id for r in d.collect()) == sorted(out.doc_id)
