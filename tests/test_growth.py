"""Cases that only larger tables brought up."""

import random
import re
from collections import Counter
from functools import partial

import duckdb
import numpy as np
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N
from claimgraph.functions import text as T
from claimgraph.operators import analytics as A
from claimgraph.operators import corpus as C
from claimgraph.operators import evidence as E
from claimgraph.operators import extract as X
from claimgraph.operators import held
from claimgraph.operators import novelty as H
from claimgraph.plans import corpus_queries as CQ
from claimgraph.plans import graph_queries as GQ
from claimgraph.plans import run_queries as RQ
from claimgraph.plans import testviews as V
from claimgraph.sources import index, io, store
from claimgraph.streaming import events as SE
from conftest import DATA
from test_graph_store import exact_betweenness


def test_sample_size_after_a_word_of_any_script(spark, tmp_path):
    texts = ["producción 89.25", "n = 40 cases", "ción n 32", "n 12é"]
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[0] for r in spark.createDataFrame(rows, "id int, t string, a string, b string, c int").orderBy("id").select(T.extract_sample_size("t", "loose")).collect()] == [None, 40, 32, None]
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = {r[0]: r[1] for r in duck.sql(f"select pmid, sample_size from ({CQ.ORACLE['quality_score']})").fetchall()}
    assert sql == {r.pmid: r.sample_size for r in CQ.quality_score(spark, str(tmp_path)).collect()}


def test_quality_of_odd_texts_is_that_of_the_sql(spark, tmp_path):
    """Blank texts, texts with words of a design, and letters of two code units before a sample size."""
    texts = [None, "", " ", "\n", "in vitro, n = 44", "a cohort", "a review of a cell line", "single-cell N:12.", "\U0001d41an 34", "\U0001f600n 35", "n 36\U0001d41a", "n, 37\n"]
    rows = [(k * 15 + j, t, "en", "web", 0) for k, t in enumerate(texts) for j in range(15)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = "pmid, evidence_level, study_design, sample_size, confidence_score"
    want = {r[0]: (*r[1:4], float(r[4])) for r in duck.sql(f"select {columns} from ({CQ.ORACLE['quality_score']})").fetchall()}
    assert {r[0]: tuple(r[1:]) for r in CQ.quality_score(spark, str(tmp_path)).collect()} == want
    assert {want[str(k * 15)][2] for k in range(len(texts))} == {None, 44, 12, 35, 37}


def test_a_context_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"tissue": {"status": "known"}, "zone": "a"}',)], "c string").select(N.structured_context("c").alias("x"))
    assert rows.first().x.errors == ["unknown context fields: zone", "tissue: known context values require value or identifier"]
    plan = rows.selectExpr("x.errors", "x.supplied", "x.tissue.raw")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("from_json", plan)) <= 7


def test_documents_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(RQ, "DOCUMENT_ROWS", 10)
    rows = spark.range(1000).select(F.lit("hub").alias("source"), F.col("id").cast("string").alias("target"), F.lit("activates").alias("relation"))
    folder = RQ._documents(rows, ["source", "target"], "edges", spark)
    edges = io.read_graph(spark, f"{folder}/*")[1]
    assert edges.select("target").distinct().count() == edges.count() == 1000
    assert max(r["count"] for r in spark.read.text(folder).select(F.size(F.split("value", '"target"')).alias("count")).collect()) < 40


def test_edges_of_a_pattern_are_rows(spark):
    edges = spark.range(500).select(F.lit("IL-11").alias("source"), F.concat(F.lit("n"), "id").alias("target"), F.lit("activates").alias("relation"), F.array(F.lit("1"), F.col("id").cast("string")).alias("pmids"), F.lit(2).alias("pmid_count"))
    p = spark.createDataFrame([("p1", "il 11", "n"), ("p2", "zz", "n")], "pattern_id string, source_term string, target_term string")
    found = H.pattern_edges(edges, p)
    assert found.count() == 500
    counts = H.pattern_counts(found, p)
    assert sorted(map(tuple, counts.collect())) == [("p1", 500, 500), ("p2", 0, 0)]
    assert "collect_" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_paired_in_a_state_of_each_run(spark, tmp_path):
    rows = [("r", s, k, i, 1000 + i) for i, (s, k) in enumerate([("a", "agent_started"), ("b", "agent_started"), ("a", "agent_completed"), ("a", "agent_completed"), ("b", "agent_started"), ("b", "agent_completed")])]
    log = spark.createDataFrame(rows, "run_id string, step_id string, event_type string, seq long, at long").withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    log.where("seq < 2").coalesce(1).write.parquet(f"{tmp_path}/in")
    paired = lambda: SE.pair_steps(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"))
    for k in range(2):
        if k:
            log.where("seq >= 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        paired().writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.step_id, r.start_seq, r.end_seq, r.duration_us) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 0, 2, 2_000_000), ("b", 4, 5, 1_000_000)]
    assert paired()._jdf.queryExecution().analyzed().groupingAttributes().size() == 1


def test_ways_over_hubs_leave_their_block_as_the_result(spark):
    rng = random.Random(5)
    rows = {(f"n{rng.randrange(60)}", f"n{int(60 * rng.random() ** 2)}") for _ in range(500)} | {("x", "y"), ("y", "n1"), ("n2", "x")}
    pairs = {(a, b) for a, b in rows if a != b}
    want = Counter((a, d) for a, b in pairs for c, d in pairs if b == c and a != d and (a, d) not in pairs)
    e = spark.createDataFrame(sorted(rows), "source string, target string")
    for heavy, block in ((60, 16), (0, 64), (10**9, 16)):
        got = A.untested_transitive(e, heavy=heavy, block=block)
        assert {(r.a, r.c): r.ways for r in got.collect()} == want
        if heavy < 10**9:  # no shuffle after the products
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert not re.search(r"(Aggregate|Join)[\s\S]*FlatMapCoGroupsInPandas", plan.split("Union")[-1])
    sparse = [np.zeros((3, 3), np.int32) for _ in range(2)]
    bits = np.random.default_rng(1).integers(0, 2, (2, 3, 64)).astype(np.uint8)
    A._add_ways(sparse[0], np.arange(3), np.arange(3), *bits)
    thin = bits * (np.arange(64) == 7).astype(np.uint8)
    A._add_ways(sparse[1], np.arange(3), np.arange(3), *thin)
    assert (sparse[0] == bits[0].astype(int) @ bits[1].T).all() and (sparse[1] == thin[0].astype(int) @ thin[1].T).all()


def test_stored_facts_are_shuffled_once(spark, tmp_path):
    base = f"file://{tmp_path}/graph"
    store.merge_run(spark, base, "run0", V.claims(spark, DATA).where("pmid < '2'"))
    plan = store.read_store(spark, base)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert store.read_store(spark, base)[1].count() == E.counted_edges(E.edge_facts(V.claims(spark, DATA).where("pmid < '2'"))).count()


def test_betweenness_in_blocks(spark):
    """Levels are products of blocks: many blocks, unreached nodes, pivots that are not all nodes."""
    rng = random.Random(8)
    names = [f"n{k:02d}" for k in range(14)]
    pairs = sorted({(rng.choice(names[:12]), rng.choice(names[2:])) for _ in range(45)} - {(n, n) for n in names})
    nodes, edges = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(pairs, "source string, target string")
    want = exact_betweenness(names, pairs)
    halves = [{r.id: r.betweenness for r in A.betweenness(nodes, edges, nodes.where(f"id {sign} 'n06'"), block=4, wide=2).collect()} for sign in ("<", ">=")]
    assert all(abs(halves[0][n] + halves[1][n] - want[n]) < 1e-9 for n in names) and sum(want.values()) > 9


def test_counts_without_papers_are_those_of_facts(spark):
    """Edges, nodes and clashing pairs counted from claims alone; labels, once a row, by alias, and claims of several papers or of none."""
    c = V.claims(spark, DATA)
    more = c.limit(3).withColumns({"source": F.lit("il 33"), "source_type": F.lit("Cytokine"), "pmids": F.array(F.lit("p1"), F.lit("p2"), F.lit("p1")), "context": F.expr("named_struct('cell_types', array('T'), 'disease', cast(array() as array<string>), 'drugs', cast(null as array<string>), 'tissues', array('x'))")})
    bare = c.limit(2).withColumns({"source": F.lit("il 33"), "source_type": F.lit("Gene"), "pmid": F.lit("")})
    c = c.unionByName(more).unionByName(bare).localCheckpoint()
    facts = E.edge_facts(c)
    nodes, found = E.counted_nodes(facts), E.counted_contradictions(facts)
    rows = lambda df, *names: sorted(map(str, df.select(*names).collect()))
    assert {"IL-33", "il 33"} <= {r.id for r in nodes.collect()}
    assert rows(E.edge_keys(c), "source", "target", "relation_key") == rows(E.counted_edges(facts), "source", "target", F.col("relation").alias("relation_key"))
    assert rows(E.node_claims(c), "id", "edge_count") == rows(nodes, "id", "edge_count")
    assert rows(E.node_papers(c), "id", "pmid_count") == rows(nodes, "id", "pmid_count")
    assert rows(E.clashing_pairs(c), "a", "b", "kind", "side_a", "side_b") == rows(found, "a", "b", "kind", "side_a", "side_b") != []
    assert E.clashing_pairs(c)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_few_names_are_looked_for_without_a_shuffle_of_texts(spark, monkeypatch):
    p = spark.createDataFrame([("1", "The IL-33 of mice"), ("1", "The IL-33 of mice"), ("2", "st2, not il 3 3"), ("3", None), ("", "il33")], "pmid string, abstract string")
    t = spark.createDataFrame([("r1", ["IL-33", "--"], ["x", "y"]), ("r2", ["Q"], ["z"])], "run_id string, genes array<string>, drugs array<string>")
    found = lambda: X._asked(p, t, "genes", "drugs", aliases={"q": ["ST2", "st-2"]})
    rows = sorted(map(tuple, found().collect()))
    assert len(rows) == 7
    assert "Exchange hashpartitioning(paper_" not in found()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(X, "FEW_NAMES", 0)
    assert sorted(map(tuple, found().collect())) == rows


def test_runs_are_read_for_a_verb_only_where_they_have_one(spark):
    """A text of one run whose only verb stands at its beginning was tried again from each of its letters; and it was read anew for every verb."""
    long = " induces " + "growth of cells " * 3_000
    rows = [("1", long), ("2", "x promotes  il-5 and y. TNF induces fibrosis　induces scars; IL-4 blocks IL-5"), ("3", None), ("4", "and induces")]
    p = spark.createDataFrame([(k, 2020, "human", t, 0.5) for k, t in rows], "pmid string, year int, species string, abstract string, confidence double")
    none = spark.createDataFrame([], "pmid string, source string, relation string, target string")
    got = X.extract_patterns(p, none)
    assert {(r.pmid, r.source, r.relation, r.target) for r in got.collect()} == {("2", "IL-4", "suppresses", "IL-5"), ("2", "Tnf", "induces", "Fibrosis　Induces Scars")}
    plan = got.select("pmid", "source", "relation", "target")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(abstract") == 1
    assert X.extract_patterns(p, none, verbs=[]).count() == 0


def test_tasks_that_make_pairs_distinct_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", 100)
    e = spark.range(1000).select(F.concat(F.lit("n"), F.col("id") % 50).alias("source"), F.concat(F.lit("n"), F.col("id") % 7).alias("target"))
    p = A.undirected(e)
    assert p.rdd.getNumPartitions() == e.where("source <> target").count() // 100 + 1 == 10
    assert {tuple(r) for r in p.collect()} == {tuple(sorted(r)) for r in e.collect() if r[0] != r[1]} and p.count() == p.distinct().count()
    nodes = e.select(F.col("source").alias("id")).distinct()
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "HashAggregate" not in plan[plan.rindex("Exchange") :]
    assert nodes.count() == A.eigenvector_centrality(nodes, e, max_iter=2, tol=0).where("eigenvector > 0").count() == 50


def test_index_terms_are_those_of_the_search(spark):
    texts = [("A-b a-B", "Zürich 3x\n3X --"), (None, None), ("", ""), ("é", "x"), ("y", None), ("İ K", "ß-1"), ("x" * 5000, "end ")]
    rows = [(str(k % 6), 2000 + k, *t) for k, t in enumerate(texts)] + [(None, None, "last", "first")]
    pubs = spark.createDataFrame(rows, "pmid string, year int, title string, abstract string")
    for d in (pubs.coalesce(1), pubs.repartition(3), pubs.limit(0), V.publications(spark, DATA)):
        got, want = (Counter(map(tuple, x.collect())) for x in (index.index_terms(d), C.text_terms(d).where("term <> ''")))
        assert got == want
    assert "split" not in index.index_terms(pubs)._jdf.queryExecution().optimizedPlan().toString()


def test_loops_of_single_papers_count(spark, tmp_path):
    """Loops are found over all pairs, not over those of two papers alone."""
    spark.createDataFrame([(k,) for k in range(12)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rng = random.Random(3)
    ends = [(1, 2), (2, 1), (2, 3), (3, 1), (3, 1), (11, 2), (1, 11)] + [(rng.randrange(12), rng.randrange(12)) for _ in range(40)]
    rows = [(k // 2, b, a, 1 + k % 2, "ARN"[k % 3], "F", 0.1) for k, (a, b) in enumerate(ends)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double").withColumn("l_shipdate", F.lit("1995-01-01").cast("date"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("supplier", "lineitem"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    columns = "path, pmid_count, completeness, category, loop_id, complete, hops"
    want = duck.sql(f"select {columns} from ({GQ.ORACLE['loops']})").fetchall()
    got = [tuple(r) for r in GQ.loops(spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    assert sorted(got) == sorted(want)
    assert {"N1>N2", "N1>N2>N3", "N1>N11>N2"} <= {r[0] for r in got} and {1, 2, 3} <= {r[1] for r in got}


def test_betweenness_of_a_held_graph(spark, monkeypatch):
    """Groups of pivots, blocks of neighbours, levels grown from either side; as in blocks of path counts and by brute force."""
    monkeypatch.setattr(held, "betweenness", partial(held.betweenness, block=4, group=3))
    rng = random.Random(4)
    names = [f"n{k:02d}" for k in range(16)]
    for many in (24, 90):
        pairs = sorted({(rng.choice(names[:14]), rng.choice(names[2:])) for _ in range(many)} - {(n, n) for n in names})
        nodes, edges = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(pairs, "source string, target string")
        want = exact_betweenness(names, pairs)
        for most in (len(pairs), 0):
            got = A.betweenness(nodes, edges, block=4, wide=2, most=most)
            got = {r.id: r.betweenness for r in got.collect()}
            assert all(abs(got[n] - want[n]) < 1e-9 for n in names) and sum(want.values()) > 9
    tasks = []
    monkeypatch.setattr(A, "_path_products", lambda *x, **y: tasks.append(x))
    A.betweenness(nodes, edges).count()
    assert not tasks


def test_loops_counted_where_they_are_found(spark, monkeypatch):
    """Groups and blocks of few nodes, pairs of several papers, of shared ones and of none; as loops with all their evidence."""
    monkeypatch.setattr(held, "short_loops", partial(held.short_loops, block=4, group=3))
    rng = random.Random(6)
    rows = [(f"n{rng.randrange(11)}", f"n{rng.randrange(11)}", rng.choice(["p1", "p2", "p3", "p4", None])) for _ in range(110)] + [("n1", "n2", None), ("n2", "n1", "p9"), ("x", "n1", "p1"), ("n1", "y", "p1")]
    claims = spark.createDataFrame(rows, "source string, target string, pmid string")
    columns = ["path", "length", "category", "completeness", "complete", "pmid_count", "number", "loop_id"]
    rules = [("hub", [["n1", "n10"], ["n3"]])]
    whole = A.counted_loops(claims, rules, most=0).select(columns).collect()
    got = A.counted_loops(claims, rules).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and {r.length for r in got} == {2, 3}
    assert len({r.completeness for r in got}) > 2 and len({r.pmid_count for r in got}) > 2
    assert A.counted_loops(claims.where("source < target")).count() == A.counted_loops(claims.limit(0)).count() == 0


def test_blocks_of_ways_are_written_once(spark):
    """Every block of a meets every block of c where it is read; dense and sparse blocks, light ways of the same ends."""
    rng = random.Random(9)
    for n, many, heavy in ((24, 400, 60), (90, 420, 0), (40, 300, 55)):
        pairs = {(f"n{rng.randrange(n)}", f"n{int(n * rng.random() ** 1.5)}") for _ in range(many)} | {("x", "n1"), ("n0", "y")}
        pairs = {(a, b) for a, b in pairs if a != b}
        want = Counter((a, d) for a, b in pairs for c, d in pairs if b == c and a != d and (a, d) not in pairs)
        got = A.untested_transitive(spark.createDataFrame(sorted(pairs), "source string, target string"), heavy=heavy, block=7)
        assert {(r.a, r.c): r.ways for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapCoGroups" not in plan
