"""Facts, the bucketed store, cycles, ways and label search against brute force; values written down from the reference's rules."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import analytics as A
from claimgraph.operators import corpus as C
from claimgraph.operators import evidence as E
from claimgraph.operators import extract as X
from claimgraph.operators import graph as G
from claimgraph.operators import novelty as H
from claimgraph.schemas import CLAIMS
from claimgraph.sources import index, io, store
from claimgraph.streaming import events as SE


def claims(spark, *rows):
    names = [f.split(" ")[0] for f in CLAIMS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CLAIMS)


def claim(s, r, t, **more):
    return {"source": s, "relation": r, "target": t} | more


def some_claims(seed=4, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s, t = rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH")
        more = {"pmid": rng.choice([None, "", *map(str, range(30))]), "year": rng.choice([None, 1999, 2005]), "confidence": rng.choice([None, 0.25, 0.75]), "session": rng.choice(["s1", "s2", None]), "species": rng.choice([None, "human"])}
        if k % 5 == 0:
            more["pmids"] = rng.choice([[], ["1", "2", "2"], ["7", None, ""]])
        if k % 3 == 0:
            more["source_sentence"] = f"{s} and {t} {k % 7}."
        if k % 11 == 0:
            more["claim_id"] = "claim_x"
        if k % 4 == 0:
            more |= {"source_type": "Drug"}
        rows.append(claim(s, rng.choice(["activates", "inhibits", "binds_target", "indirectly_modulates", None]), t, **more))
    return rows


def by_key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_counts_are_those_of_the_arrays(spark):
    c = claims(spark, *some_claims())
    names = ["claim_id", "source", "target", "relation", "pmid_count", "conf_n", "evidence_strength", "evidence_state", "source_type", "target_type", "provenance_type"]
    edges, counts = G.build_edges(c), E.counted_edges(E.edge_facts(c))
    assert by_key(edges.collect(), *names) == by_key(counts.collect(), *names)
    sums = lambda df: {r.claim_id: round(r.conf_sum, 6) for r in df.collect()}
    assert sums(edges) == sums(counts)
    nodes = ["id", "type", "pmid_count", "edge_count", "provenance_type"]
    assert by_key(G.build_nodes(c).collect(), "id", "pmid_count", "edge_count", "provenance_type") == by_key(E.counted_nodes(E.edge_facts(c)).collect(), "id", "pmid_count", "edge_count", "provenance_type")
    assert set(nodes) == set(E.counted_nodes(E.edge_facts(c)).columns)
    a, b = A.contradictions(edges), E.counted_contradictions(E.edge_facts(c))
    assert sorted((r.a, r.b, r.kind, r.side_a, r.relations_a, r.relations_b, len(r.pmids_a), len(r.pmids_b)) for r in a.collect()) == sorted((r.a, r.b, r.kind, r.side_a, r.relations_a, r.relations_b, r.n_a, r.n_b) for r in b.collect())
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (counts, b)]
    assert all("collect_set(paper" not in p and "collect_list(paper" not in p for p in plans)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_store_merges_in_proportion(spark, tmp_path):
    rows = [claim(f"N{k % 997}", "activates", f"M{k % 1009}", pmid=str(k), session="s", source_sentence=f"sentence {k}") for k in range(30_000)]
    new = [claim(f"N{k}", "activates", f"M{k}", pmid=f"9{k}", session="t") for k in range(4)]
    base = str(tmp_path / "graph")
    assert store.read_store(spark, base)[1].count() == 0
    assert store.merge_run(spark, base, "one", claims(spark, *rows)) == 1
    assert store.merge_run(spark, base, "two", claims(spark, *new)) == 2
    first, second = size_of(f"{base}/facts/run=one"), size_of(f"{base}/facts/run=two")
    assert second < first / 20
    touched = {r.bucket for r in store.live(spark, base).where("run = 'two'").collect()}
    assert len(touched) <= 4
    changed = store.changed_edges(spark, base, "two")
    before = {(r.source, r.target): r.pmid_count for r in E.counted_edges(E.edge_facts(claims(spark, *rows))).collect()}
    assert {(r.source, r.target): r.pmid_count for r in changed.collect()} == {(f"N{k}", f"M{k}"): before.get((f"N{k}", f"M{k}"), 0) + 1 for k in range(4)}
    assert len(changed.inputFiles()) <= 4 * len(touched) < store.BUCKETS
    whole = claims(spark, *rows, *new)
    names = ["claim_id", "source", "target", "relation", "pmid_count", "conf_n", "n_refs"]
    want = by_key(E.counted_edges(E.edge_facts(whole)).collect(), *names)
    assert by_key(store.read_store(spark, base)[1].collect(), *names) == want
    # merging a run again changes nothing, old versions stay readable, compaction keeps the rows
    store.merge_run(spark, base, "two", claims(spark, *new))
    assert by_key(store.read_store(spark, base)[1].collect(), *names) == want
    assert store.read_store(spark, base, version=1)[1].count() == E.counted_edges(E.edge_facts(claims(spark, *rows))).count()
    store.compact(spark, base, "whole", most=1)
    assert by_key(store.read_store(spark, base)[1].collect(), *names) == want
    assert {r.run for r in store.live(spark, base).where(F.col("bucket").isin(*touched)).collect()} == {"whole"}
    nodes = by_key(E.counted_nodes(E.edge_facts(whole)).collect(), "id", "type", "pmid_count", "edge_count")
    assert by_key(store.read_store(spark, base)[0].collect(), "id", "type", "pmid_count", "edge_count") == nodes


def brute_cycles(pairs, most):
    out, nodes = set(), sorted({x for p in pairs for x in p})
    after = {n: [t for s, t in pairs if s == n] for n in nodes}

    def walk(path):
        for t in after[path[-1]]:
            if t == path[0] and len(path) > 1:
                out.add(tuple(path))
            elif t > path[0] and t not in path and len(path) < most:
                walk([*path, t])

    for n in nodes:
        walk([n])
    return out


@pytest.mark.parametrize("seed, n, share", [(1, 9, 0.25), (2, 14, 0.12), (3, 6, 0.9), (4, 20, 0.05)])
def test_cycles_of_up_to_six(spark, seed, n, share):
    rng = random.Random(seed)
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a in range(n) for b in range(n) if rng.random() < share] or [("n00", "n01")]
    found = A.simple_cycles(spark.createDataFrame(pairs, "source string, target string"), 6).collect()
    got = [tuple(r.path) for r in found]
    assert len(set(got)) == len(got) and all(len(r.path) == r.length for r in found)
    assert set(got) == brute_cycles({p for p in pairs if p[0] != p[1]}, 6)


def test_strong_pairs(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "x"), ("g", "a")]
    got = {tuple(r) for r in A.strong_pairs(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == {("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d")}
    assert A.strong_pairs(spark.createDataFrame([("a", "b")], "source string, target string")).collect() == []
    assert A.simple_cycles(spark.createDataFrame([], "source string, target string")).collect() == []


@pytest.mark.parametrize("heavy, block", [(0, 3), (6, 4), (10**9, 4)])
def test_ways_over_light_and_heavy_nodes(spark, heavy, block):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(60)} | {(f"n{k}", "hub") for k in range(12)} | {("hub", f"n{k}") for k in range(3, 14)}
    pairs = {p for p in pairs if p[0] != p[1]}
    want = {}
    for (a, b), (c, d) in itertools.product(pairs, pairs):
        if b == c and a != d and (a, d) not in pairs:
            want[a, d] = want.get((a, d), 0) + 1
    e = spark.createDataFrame(sorted(pairs), "source string, target string")
    got = {(r.a, r.c): r.ways for r in A.untested_transitive(e, heavy=heavy, block=block).collect()}
    assert got == want
    top = A.untested_transitive(e, heavy=heavy, block=block, top=2).collect()
    for a in {k[0] for k in want}:
        best = sorted(((-w, c) for (x, c), w in want.items() if x == a))[:2]
        assert sorted((-r.ways, r.c) for r in top if r.a == a) == best


def test_labels_with_terms(spark):
    rng = random.Random(3)
    letters = "ab1-/ β"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    labels = [word(rng.randint(0, 9)) for _ in range(80)] + ["IL-11 receptor", None, "IL11"]
    terms = [word(rng.randint(0, 4)) for _ in range(30)] + ["IL 11", "il11", "...", None]
    normal = lambda x: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (x or "").lower()).split()
    want = {(t, x) for t in set(terms) for x in set(labels) if " ".join(normal(t)) in " ".join(normal(x))}
    got = H.labels_with(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {tuple(r) for r in got.collect()} == want


def test_patterns_in_any_script(spark):
    p = spark.createDataFrame([("1", 2020, "human", "TGF-β induces fibrosis. IFN-γ suppresses cell growth. TNF induces fibrosis", 0.5)], "pmid string, year int, species string, abstract string, confidence double")
    none = spark.createDataFrame([], "pmid string, source string, relation string, target string")
    got = {(r.source, r.relation, r.target) for r in X.extract_patterns(p, none, [("nothing", "Nothing")]).collect()}
    assert {(s.lower(), r, t.lower()) for s, r, t in got} == {("tgf-β", "induces", "fibrosis"), ("ifn-γ", "suppresses", "cell growth"), ("tnf", "induces", "fibrosis")}


def test_loops_as_the_reference_ranks_them(spark):
    edges = [("A", "B", ["1", "2", "3"]), ("B", "A", []), ("C", "D", ["4"]), ("D", "C", ["5"]), ("IL-33", "ILC2", ["6"]), ("ILC2", "IL-33", ["6"]), ("IL-33", "Z", ["6"]), ("Z", "IL-33", ["7"])]
    e = spark.createDataFrame(edges, "source string, target string, pmids array<string>")
    loops = A.build_loops(e, A.simple_cycles(e))
    by = {tuple(r.path): r for r in loops.collect()}
    assert {p: (r.loop_id, r.category, r.completeness, r.pmid_count, r.complete) for p, r in by.items()} == {
        ("A", "B"): ("L001", "positive_feedback", 0.5, 3, True),
        ("C", "D"): ("L002", "positive_feedback", 1.0, 2, True),
        ("IL-33", "ILC2"): ("L003", "cytokine_amplification", 1.0, 1, True),
        ("IL-33", "Z"): ("L004", "positive_feedback", 1.0, 2, True),
    }
    assert by["A", "B"].hop_pmids == {"A->B": ["1", "2", "3"], "B->A": []}
    top = A.rank_architectures(loops).collect()
    assert [(r["rank"], r.name, r.composite_score) for r in top] == [
        (1, "positive_feedback:C -> D", 2.0),
        (2, "positive_feedback:IL-33 -> Z", 2.0),
        (3, "cytokine_amplification:IL-33 -> ILC2", 1.0),
        (4, "positive_feedback:A -> B", 1.5),
    ]


def test_candidates_as_the_reference_states_them(spark):
    c = spark.createDataFrame([("r", "IL-4", "IFN-γ"), ("r", None, None)], "run_id string, a string, b string")
    g = spark.createDataFrame([("r", "axis", "A → B"), ("r", None, "C → D"), ("r", "bare", None)], "run_id string, architecture string, missing_edge string")
    runs = spark.createDataFrame([("r", "asthma"), ("q", "IPF")], "run_id string, disease string")
    got = {(r.run_id, r.candidate_id): r.statement for r in H.candidate_manifest(c, g, runs).collect()}
    assert got == {
        ("r", "C001"): "Resolve contradiction 1 in asthma",
        ("r", "C002"): "Which condition determines whether IL-4 -> IFN-γ or the reverse dominates?",
        ("r", "G003"): "C → D in asthma (global)",
        ("r", "G004"): "A → B in asthma (axis)",
        ("q", "G001"): "Mechanistic gap candidates in IPF",
    }


def test_patterns_keep_separators_as_blanks(spark):
    e = spark.createDataFrame([("TGFβ signaling", "IL-11", "activates", 2, ["1", "2"]), ("IL11", "Myofibroblast", "induces", 1, ["3"]), ("IL-11", "Myofibroblast", "induces", 4, ["2", "4", "5", "6"])], "source string, target string, relation string, pmid_count int, pmids array<string>")
    p = spark.createDataFrame([("H001", "TGFβ signaling", "IL-11"), ("H001", "IL-11", "Myofibroblast"), ("H003", "Smad2", "IL-11")], "pattern_id string, source_term string, target_term string")
    got = {r.pattern_id: r for r in H.supported_patterns(e, p).collect()}
    assert (got["H001"].edges, got["H001"].pmid_count) == (2, 5) and (got["H003"].edges, got["H003"].pmid_count, got["H003"].supporting_edges) == (0, 0, [])
    assert [(x.source, x.sample_pmids) for x in got["H001"].supporting_edges] == [("IL-11", ["2", "4", "5"]), ("TGFβ signaling", ["1", "2"])]


def test_novelty_classes(spark):
    rows = [
        ("canonical", [0, 0], True, False, 2, 1, "A"), ("many", [101, 0], False, False, 2, 1, "A"), ("some", [51, 3], False, False, 2, 1, "B"), ("clash", [3, 0], False, True, 2, 1, "C"), ("none", [0, 0], False, False, 2, 1, "E"),
        ("partly", [0], False, False, 2, 1, "D"), ("few", [3, 0], False, False, 2, 2, "B"), ("one corpus", [0], False, False, 2, 0, "invalid"), ("no search", [], False, False, 2, 1, "invalid"), ("few, partly", [3, 0], False, False, 3, 1, "D"),
    ]
    df = spark.createDataFrame(rows, "id string, hits array<long>, canonical boolean, conflicting boolean, hops long, evidenced long, want string")
    assert [(r.id, r["class"]) for r in H.novelty_class(df).collect()] == [(r[0], r[-1]) for r in rows]


def test_default_motifs(spark):
    e = spark.createDataFrame([("Th2 cell", "IL-4", ["1"], 0.5), ("IL-4", "Th2 cell", ["2"], 0.7), ("ILC2", "IL-5", ["3"], 0.9)], "source string, target string, pmids array<string>, confidence double")
    got = {r.name: r for r in A.motif_completeness(e).collect()}
    assert len(got) == 10
    r = got["IL-4/IL-13 effector axis"]
    assert (r.edges_present, r.edges_total, r.nodes_present, r.nodes_total, r.pmid_count, r.category) == (2, 2, 3, 3, 2, "positive feedback loop")
    assert got["IL-5 eosinophil amplification"].nodes_present == 2


def test_requests_meet_papers_that_mention_them(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("aAb1-β ") for _ in range(n))
    pubs = [(str(k), word(rng.randint(0, 40)), 2000, "human") for k in range(60)] + [("60", None, 1, "x"), (None, "ab ab", 1, "x"), ("", "ab ab", 1, "x"), ("5", "TNF-alpha and tumor necrosis factor", 1, "x")] * 2
    targets = [(f"r{k}", [word(rng.randint(1, 4)) for _ in range(3)] + [None, "...", "tnf"], [word(2)]) for k in range(6)]
    p = spark.createDataFrame(pubs, "pmid string, abstract string, year int, species string")
    t = spark.createDataFrame(targets, "run_id string, genes array<string>, drugs array<string>")
    aliases = {"tnf": ["tumor necrosis factor"]}
    flat = lambda x: "".join(c for c in (x or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    want = []
    for pmid, abstract, *_ in pubs:
        for run, genes, drugs in targets:
            for g in set(genes):
                keys = [flat(x) for x in [g, *aliases.get((g or "").lower(), [])]]
                want += [(pmid, run, g, d) for d in set(drugs) if pmid and abstract and any(k and k in flat(abstract) for k in keys)]
    got = X._asked(p, t, "genes", "drugs", aliases=aliases)
    assert sorted((r.pmid, r.run_id, r.gene, r.drug) for r in got.collect()) == sorted(want) and want


def exact_betweenness(nodes, pairs):
    after = {n: [t for s, t in pairs if s == n] for n in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        level, paths, dist, order = [s], {s: 1.0}, {s: 0}, [s]
        while level:
            nxt = []
            for v in level:
                for w in after[v]:
                    if w not in dist:
                        dist[w], paths[w] = dist[v] + 1, 0.0
                        nxt.append(w)
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
            level = nxt
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if w in after[v] and dist[w] == dist[v] + 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def test_sampled_betweenness_is_near_the_exact_one(spark):
    rng = random.Random(6)
    names = [f"n{k:02d}" for k in range(24)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(60)} - {(n, n) for n in names})
    nodes, edges = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(pairs, "source string, target string")
    want = exact_betweenness(names, pairs)
    exact = {r.id: r.betweenness for r in A.betweenness(nodes, edges).collect()}
    assert exact == pytest.approx(want)
    got = A.sampled_betweenness(nodes, edges, error=0.05, first=4096).collect()
    assert len(got) == 24 and got[0].error <= 0.05
    worst = max(abs(r.betweenness - want[r.id]) for r in got) / 24**2
    assert worst <= got[0].error and worst < 0.02 and max(want.values()) / 24**2 > 0.1
    assert A.sampled_betweenness(nodes.limit(2), edges.limit(0)).count() == 2
    assert {r.betweenness for r in A.sampled_betweenness(nodes, edges.limit(0), error=0.2).collect()} == {0.0}


def test_broken_documents_are_kept_aside(spark, tmp_path):
    good = '{"pmid": "1", "title": "t", "year": 2000}'
    for name, text in {"a.json": f"[{good}]", "b.json": '{"publications": [%s, {"title": "none"}]}' % good.replace('"1"', '"2"'), "c.json": '{"pmid": "3", "title": '}.items():
        (tmp_path / name).write_text(text)
    rows, bad = io.checked_publications(spark, str(tmp_path))
    assert sorted(r.pmid for r in rows.collect()) == ["1", "2"] and "file" not in rows.columns
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("b.json", "no pmid"), ("c.json", "corrupt record")]
    xml = tmp_path / "x.xml"
    xml.write_text("<Set><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>a</ArticleTitle></Article></MedlineCitation></PubmedArticle>\n<PubmedArticle><MedlineCitation><PMID>2</PMIX></MedlineCitation></PubmedArticle><PubmedArticle a='b'><MedlineCitation><PMID>3</PMID></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>4")
    rows, bad = io.checked_publications_xml(spark, str(xml))
    assert sorted(r.pmid for r in rows.collect()) == ["1", "3"]
    assert [r.reason for r in bad.collect()] == ["corrupt record"] * 2 and all("PMID" in r.record for r in bad.collect())


def test_index_reads_its_terms_buckets(spark, tmp_path):
    pubs = spark.createDataFrame([(str(k), f"title w{k % 7}", f"common w{k % 11} text", 2000 + k % 5) for k in range(200)], "pmid string, title string, abstract string, year int")
    asked = spark.createDataFrame([("s", [["w3", "w5"], ["common"]], 2001, 2003), ("none", [["zzz"]], 0, 9999)], "strategy string, groups array<array<string>>, year_from int, year_to int")
    base = str(tmp_path / "index")
    index.write_index(pubs.where("pmid < '5'"), base)
    index.write_index(pubs.where("pmid >= '5'"), base, mode="append")
    for a, b in zip(C.search_corpus(pubs, asked), index.search_index(spark, base, asked)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    read = index.read_postings(spark, base, asked)
    assert "PartitionFilters: [bucket" in read._jdf.queryExecution().simpleString().replace("#", " #").split("FileScan")[-1].replace(" #", "#")
    pages, cursor = [], None
    while True:
        page = index.next_page(spark, base, asked, cursor, per_query=7).where("strategy = 's'").orderBy("rank").collect()
        if not page:
            break
        pages += page
        cursor = spark.createDataFrame([("s", page[-1].year, page[-1].pmid)], "strategy string, year int, pmid string")
    order = sorted(pages, key=lambda r: (-r.year, int(r.pmid)))
    assert pages == order and len({r.pmid for r in pages}) == len(pages) == C.search_corpus(pubs, asked)[0].where("strategy = 's'").first().total


def test_silent_runs_leave_the_store(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "agent_started", "x", 5, 1000.0), ("b", 2, "agent_started", "x", 5, 2000.0)], "run_id string, arrival long, event_type string, step_id string, tokens long, at double")
    late = spark.createDataFrame([("b", 3, "agent_started", "x", 5, 1e7), ("c", 4, "agent_started", "x", 5, 1e7)], log.schema)
    last = spark.createDataFrame([("a", 5, "agent_started", "x", 5, 1e7 + 10), ("b", 6, "agent_started", "x", 5, 1e7 + 10)], log.schema)
    stamped = lambda df: df.withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    out, before = {}, spark.conf.get("spark.sql.shuffle.partitions")
    for part in (log, late, last):
        stamped(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(stamped(part).schema).parquet(str(tmp_path / "in"))
        q = SE.sequence_events(stream).writeStream.foreachBatch(lambda df, n: out.update({r.arrival: r.seq for r in df.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    # ``a`` was silent for longer than a month and starts anew; ``b`` goes on
    assert out[1] == 0 and out[2] == 0 and out[4] == 0 and out[5] == 0 and out[6] == out[3] + 1
