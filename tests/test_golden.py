"""Small golden cases of the operators, and properties of gates, merges and plans."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from claimgraph.functions import text as T
from claimgraph.functions.normalize import context_value, looks_like_noise, normalize_drug, normalize_entities
from claimgraph.operators import analytics as A
from claimgraph.operators import corpus as C
from claimgraph.operators import extract as X
from claimgraph.operators import gates as GT
from claimgraph.operators import graph as G
from claimgraph.operators import runs as R
from claimgraph.operators import views as VW
from claimgraph.plans import testviews as V
from claimgraph.schemas import CLAIMS
from claimgraph.sources import io
from conftest import DATA


def claims(spark, *rows):
    names = [f.split(" ")[0] for f in CLAIMS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CLAIMS)


def claim(s, r, t, **more):
    return {"source": s, "relation": r, "target": t} | more


def test_opposite_claims_stay_apart(spark):
    c = claims(spark, claim("A", "activates", "B", pmid="1", session="s1", source_sentence="one"), claim("A", "inhibits", "B", pmids=["2", "3"], provenance_type="canonical_db"))
    e = {r.relation: r for r in G.build_edges(c).collect()}
    assert set(e) == {"activates", "inhibits"}
    assert e["activates"].pmids == ["1"] and e["activates"].source_refs[0].source_sentence == "one"
    assert e["inhibits"].pmids == ["2", "3"] and e["inhibits"].provenance_type == "canonical_db"
    assert e["activates"].claim_id == G.build_edges(c).where("relation = 'activates'").first().claim_id


def test_drug_mechanism_is_one_edge_and_roles_stay_apart(spark):
    c = claims(
        spark,
        claim("Itepekimab", "binds_target", "IL33", source_type="Drug", target_type="Cytokine", pmid="1"),
        claim("itepekimab", "indirectly_modulates", "IL-33", source_type="Drug", target_type="Cytokine", pmid="2"),
        claim("IL33", "activates", "ILC2", source_type="Gene", target_type="Cell", pmid="3"),
    )
    e = G.build_edges(c).where("relation = 'drug_mechanism'").collect()
    assert len(e) == 1 and e[0].pmids == ["1", "2"] and e[0].relations == ["binds_target", "indirectly_modulates"] and e[0].evidence_state == "mixed"
    assert {r.id for r in G.build_nodes(c).collect()} == {"itepekimab", "IL-33", "IL33", "ILC2"}


def test_merge_keeps_id_and_is_order_free(spark):
    a = claims(spark, claim("A", "activates", "B", pmid="1", confidence=0.9, claim_id="claim_legacy", session="s1"), claim("A", "activates", "B", pmid="2", confidence=0.5, claim_id="claim_legacy", session="s1"))
    b = claims(spark, claim("A", "activates", "B", pmid="3", confidence=0.1, session="s2"))
    _, e = G.merge_graph(G.build_nodes(a), G.build_edges(a), b)
    r = e.collect()
    assert len(r) == 1 and r[0].claim_id == "claim_legacy" and r[0].pmids == ["1", "2", "3"] and r[0].sessions == ["s1", "s2"] and abs(r[0].confidence - 0.5) < 1e-9
    _, back = G.merge_graph(G.build_nodes(b), G.build_edges(b), a)
    assert abs(back.first().confidence - 0.5) < 1e-9
    n, _ = G.merge_graph(G.build_nodes(claims(spark, claim("X", "r", "Y", pmid="9"))), G.build_edges(claims(spark)), b)
    assert {x.id for x in n.collect()} == {"A", "B", "X", "Y"}


def test_gates(spark):
    good = claim("IL-33", "activates", "ILC2", source_type="Cytokine", target_type="Cell", pmid="1", source_sentence="IL33 activates ILC2.")
    bad = claim("TNF", "induces", "Unknown fragment", source_type="Molecule", target_type="unknown", pmid="2", provenance_type="unknown")
    pubs = spark.createDataFrame([("1", "asthma", "x"), ("2", "other", "y")], "pmid string, title string, abstract string")
    g = GT.quality_gate(claims(spark, good, bad), ["asthma"], pubs)
    ok, no = GT.split_gate(g)
    assert ok.count() == 1 and no.first().reasons == ["missing_source_sentence", "unknown_node_type", "non_pmid_provenance", "target_relevance_not_demonstrated"]
    s = GT.semantic_gate(claims(spark, claim("ILC2", "suppresses", "lung", source_type="Cell", target_type="Tissue", source_sentence="ILC2 cells were detected in the lung.")), ["lung"])
    assert s.first().reasons == ["causal_direction_not_supported"]


def test_quality_score(spark):
    p = spark.createDataFrame(
        [("a", "A single-cell study in human tissue enrolled N=12 patients.", "human", "lung", "T", None, ["Journal Article"]), ("b", "A mechanism was observed.", "unknown", None, None, None, None)],
        "pmid string, abstract string, species string, tissue string, cell_type string, model string, publication_types array<string>",
    )
    q = {r.pmid: r.quality for r in C.quality_score(p).collect()}
    assert q["a"].study_design == "single_cell" and q["a"].sample_size == 12 and "small_sample_size" in [x.name for x in q["a"].penalties]
    assert q["a"].context_completeness.tissue and not q["a"].context_completeness.model
    assert q["b"].sample_size is None and "sample_size_unknown" in [x.name for x in q["b"].penalties]


def test_drug_and_gene_claims(spark):
    t = "run_id string, disease string, genes array<string>, drugs array<string>, tissues array<string>, cell_types array<string>"
    pub = lambda a: spark.createDataFrame([("1", 2020, "human", a)], "pmid string, year int, species string, abstract string")
    x = spark.createDataFrame([("r", "d", ["BRAF"], ["vemurafenib"], [], [])], t)
    p = pub("Vemurafenib is a selective BRAF inhibitor. Vemurafenib resistance activates the MAPK pathway.")
    assert X.extract_drug_claims(p, x).first().predicate == "binds_target"
    assert X.extract_drug_pathways(p, x).first().target == "MAPK"
    assert X.extract_gene_pathways(pub("BRAF V600E mutations activate the MAPK pathway and promote proliferation."), x).first().relation == "activates"
    for text in ("BRAF inhibitors improved survival and affected the MAPK pathway.", "BRAF inhibitors target the mitogen-activated protein kinase pathway."):
        assert X.extract_gene_pathways(pub(text), x).count() == 0
    m = spark.createDataFrame([("r", "d", ["PRKAA1"], ["metformin"], [], [])], t)
    p = pub("Metformin enhanced AMPK activation and increased PRKAA1 activity in type 2 diabetes.")
    assert X.extract_drug_claims(p, m).first().predicate == "indirectly_modulates" and X.extract_drug_pathways(p, m).first().target == "AMPK"


def test_templates_by_token_agree_and_patterns(spark):
    p = spark.createDataFrame([("1", 2020, "human", "IL-33 activates ILC2. ILC2 produce IL-5.", 0.5), ("2", 2020, "human", "nothing", 0.5)], "pmid string, year int, species string, abstract string, confidence double")
    a = X.extract_templates(p, [("IL-33", "activates", "ILC2", "il-?33.*?ilc2")])
    t = spark.createDataFrame([("IL-33", "activates", "ILC2", "ilc2", "il-?33.*?ilc2")], "source string, relation string, target string, token string, pattern string")
    assert a.select("pmid", "source").collect() == X.extract_templates_by_token(p, t).select("pmid", "source").collect()
    assert a.first().source_sentence == "IL-33 activates ILC2."
    q = spark.createDataFrame([("1", 2020, "human", "tslp activates dendritic cells strongly", 0.5)], "pmid string, year int, species string, abstract string, confidence double")
    got = X.extract_patterns(q, a, [("tslp", "TSLP"), ("dendritic cells", "Dendritic cell")]).first()
    assert (got.source, got.relation, got.target) == ("TSLP", "activates", "Dendritic cell") and abs(got.confidence - 0.35) < 1e-9


def test_contradictions_found_and_agreement_spared(spark):
    rows = [("Batf3", "suppresses", "D"), ("Batf3", "induces", "D"), ("Eosinophil", "activates", "IL-25"), ("IL-25", "suppresses", "Eosinophil"), ("IL-5", "recruits", "Eosinophil"), ("IL-5", "induces", "Eosinophil")]
    c = A.contradictions(G.build_edges(claims(spark, *(claim(s, r, t, pmid=str(i)) for i, (s, r, t) in enumerate(rows)))))
    assert sorted(r.kind for r in c.collect()) == ["reverse", "same_direction"] and "winner" not in c.columns


def test_run_status(spark):
    e = lambda *kinds: spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "run_id string, seq long, event_type string")
    r = R.run_status(e("agent_started", "run_failed", "run_failed")).first()
    assert r.status == "failed" and r.first_error_seq == 1
    assert R.run_status(e("run_failed", "run_retried", "agent_started", "run_completed")).first().status == "completed"
    assert R.run_status(e("run_failed", "run_retried")).first().status == "running"
    assert R.run_status(e("run_paused")).first().status == "paused"
    assert R.run_status(e("run_paused", "run_resumed")).first().status == "running"


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(T.class_code(F.lit("class D")).alias("a"), T.class_code(F.lit("restated")).alias("b"), T.class_code(F.lit("zz")).alias("c"), T.evidence_strength(F.lit(3)).alias("d"), T.slugify(F.lit("--")).alias("e"), T.truncate(F.lit("abcdef"), 4).alias("f"), T.padded(F.lit(1234)).alias("g")).first()
    assert tuple(got) == ("D", "RESTATED", "UNKNOWN", "strong", "target", "abc…", "1234")
    assert one.select(context_value(F.lit(" ")).alias("x")).first().x.status == "unknown"
    assert one.select(context_value(F.lit("lung")).alias("x")).first().x.raw == "lung"
    assert one.select(looks_like_noise(F.lit("the cell")).alias("x")).first().x and not one.select(looks_like_noise(F.lit("Mast cell")).alias("x")).first().x
    d = one.select(normalize_drug(F.lit('{"name":"x","claims":[{"predicate":"p","object":"o"}]}')).alias("x")).first().x
    assert d.status == "unresolved" and d.claims == []
    rows = spark.createDataFrame([("IL 33", "Cytokine"), ("il-33", "Cytokine"), ("zzz", "Gene")], "label string, type string")
    alias = spark.createDataFrame([("Cytokine", "il33", "IL-33")], "type string, key string, canonical string")
    assert sorted((r.normalized, r.status) for r in normalize_entities(rows, alias).collect()) == [("IL-33", "normalized"), ("zzz", "unresolved")]
    assert one.select(T.canonical_key_nfkc(F.lit("ＩＬ－33")).alias("x")).first().x == "il33"


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert {r.id: r.betweenness for r in A.betweenness(n, e).collect()} == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    assert abs(A.pagerank(n, e, tol=1e-6).agg(F.sum("pagerank")).first()[0] - 1) < 1e-6


def test_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>t</ArticleTitle><Abstract><AbstractText Label='AIM'>x</AbstractText><AbstractText>y</AbstractText></Abstract>"
        "<Journal><Title>j</Title><JournalIssue><PubDate><MedlineDate>2019 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation>"
        "<PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    )
    r = io.read_publications_xml(spark, str(tmp_path / "a.xml")).first()
    assert (r.pmid, r.abstract, r.year, r.doi) == ("7", "AIM: x y", 2019, "10.1/x")
    (tmp_path / "p.json").write_text('{"publications":[{"pmid":"1","title":"a"},{"pmid":"2","title":"b"}]}')
    (tmp_path / "q.json").write_text('[{"pmid":"3","title":"c"}]')
    assert {x.pmid for f in "pq" for x in io.read_publications(spark, str(tmp_path / f"{f}.json")).collect()} == {"1", "2", "3"}
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"A"}],"edges":[{"source":"A","target":"B","primary_relation":"induces","pmid":"1","evidence_sentences":{"1":"s"}}],"metadata":{"disease":"d"}}')
    n, e, m = io.read_graph(spark, str(tmp_path / "g.json"))
    x = e.first()
    assert n.count() == 1 and x.relation == "induces" and x.pmids == ["1"] and x.source_refs[0].source_sentence == "s" and io.graph_catalog(m).first().edge_count == 1
    base = str(tmp_path / "store")
    for run in ("r1", "r2"):
        io.write_graph(n, base, "nodes", "s", run)
    stored = spark.read.parquet(f"{base}/nodes")
    catalog = spark.createDataFrame([Row(scope="s", run_id="r1", updated="1"), Row(scope="s", run_id="r2", updated="2")])
    assert {r.run_id for r in io.latest_graph(stored, catalog).collect()} == {"r2"}


def test_export_manifest_and_plans(spark):
    c = V.claims(spark, DATA)
    e, n = G.build_edges(c), G.build_nodes(c)
    view_n, view_e, m = VW.export_view(n, e, "pmid_count >= 3")
    assert m.first().exported_edges == view_e.count() and m.first().exported_nodes == view_n.count()
    for df in (e, n, A.contradictions(e), GT.gate_report(GT.semantic_gate(c))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan


def test_graph_queries_use_all_claims(spark, tmp_path):
    """A hub with many claims keeps all its pairs; betweenness equals brute force over them."""
    from collections import deque
    from datetime import date

    from claimgraph.plans import graph_queries as Q
    from claimgraph.plans import run_queries as RQ

    links = [(1, 2), (1, 3), (1, 4), (1, 5), (1, 1), (2, 6), (3, 6), (4, 6), (5, 0), (6, 7), (7, 1), (1, 5)]
    rows = [(k, t, s, 1, "R", "F", date(1995, 1, 1), 0.0) for k, (s, t) in enumerate(links)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate date, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 9).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    d = str(tmp_path)
    pairs = {(f"N{s}", f"N{t}") for s, t in links if s != t}
    assert {tuple(r) for r in V.claim_pairs(spark, d).collect()} == pairs
    ids = sorted({x for p in pairs for x in p})
    ways = {}
    for a in ids:  # all shortest paths
        found, queue = {a: [[a]]}, deque([a])
        while queue:
            v = queue.popleft()
            for s, t in pairs:
                if s == v and t not in found:
                    found[t] = []
                    queue.append(t)
                if s == v and (not found[t] or len(found[t][0]) == len(found[v][0]) + 1):
                    found[t] += [[*p, t] for p in found[v]]
        ways |= {(a, b): p for b, p in found.items()}
    want = {x: sum(sum(x in p[1:-1] for p in w) / len(w) for w in ways.values()) for x in ids}
    got = {r.id: r.betweenness for r in Q.betweenness(spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in ids)
    two = {(a, c) for a, b in pairs for x, c in pairs if b == x and a != c} - pairs
    assert {(r.a, r.c) for r in Q.untested_transitive_all(spark, d).collect()} == two
    assert {r.component for r in Q.components_all(spark, d).collect()} == {"N0"}
    assert {(r.source, r.target) for r in RQ.node_set_view_all(spark, d).collect()} >= {p for p in pairs if p[0] == "N1"}
