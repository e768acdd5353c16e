"""Graph views (V1-V9) and the export view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocab import TYPE_RANK


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


def filter_view(nodes: DataFrame, edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V1: nodes that meet the condition, their induced edges, and what is hidden."""
    n = nodes.where(condition)
    e = induced(edges, n)
    mark = lambda end: n.select(F.col("id").alias(end)).distinct().withColumn(f"{end}_", F.lit(True))
    marked = edges.join(mark("source"), "source", "left").join(mark("target"), "target", "left")
    hidden = nodes.agg(F.count("*").alias("a"), F.count_if(condition).alias("b")).crossJoin(marked.agg(F.count("*").alias("c"), F.count_if(F.col("source_") & F.col("target_")).alias("d")))
    return n, e, hidden.select(F.col("b").alias("nodes"), F.col("d").alias("edges"), (F.col("a") - F.col("b")).alias("hidden_nodes"), (F.col("c") - F.col("d")).alias("hidden_edges"))


def min_support_view(nodes: DataFrame, edges: DataFrame, k: int = 2, by_nodes: bool = False) -> tuple[DataFrame, DataFrame]:
    """V2: edges with k papers or more and the nodes on them; ``by_nodes`` asks k papers of the nodes too."""
    e = edges.where(F.col("pmid_count") >= k)
    if by_nodes:
        n = nodes.where(F.col("pmid_count") >= k)
        return n, induced(e, n)
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), e


def node_set_view(nodes: DataFrame, edges: DataFrame, ids: list[str], hops: int = 0) -> tuple[DataFrame, DataFrame]:
    """V3: the sub-network of a named set, widened by ``hops`` steps; edges inside the set are solid, others dashed."""
    named = F.col("id").isin(ids)
    core = nodes.where(named)
    wide = core.select("id")
    for _ in range(hops):
        out = edges.join(wide, edges.source == wide.id, "left_semi").select(F.col("target").alias("id"))
        back = edges.join(wide, edges.target == wide.id, "left_semi").select(F.col("source").alias("id"))
        wide = wide.union(out).union(back).distinct()
    n = nodes.join(wide, "id", "left_semi")
    solid = F.col("source").isin(ids) & F.col("target").isin(ids)
    return n, induced(edges, n).withColumn("style", F.when(solid, "solid").otherwise("dashed"))


def module_view(nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """V4: edges inside the union of modules (module, id) with both ends' modules."""
    m = modules
    out = edges.join(m.select(F.col("id").alias("source"), F.col("module").alias("source_module")), "source")
    return out.join(m.select(F.col("id").alias("target"), F.col("module").alias("target_module")), "target")


def find_nodes(nodes: DataFrame, term: str) -> DataFrame:
    """V5: nodes whose label has the term, case aside."""
    return nodes.where(F.contains(F.lower("id"), F.lit(term.lower())))


def connections(edges: DataFrame, node: str) -> DataFrame:
    """V6: edges of a node with the other end and the direction, most papers first; a self-loop counts once, as out."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("other"), "relation", "pmid_count")
    into = edges.where((F.col("target") == node) & (F.col("source") != node)).select(F.lit("in").alias("direction"), F.col("source").alias("other"), "relation", "pmid_count")
    return out.union(into).orderBy(F.desc("pmid_count"), "other", "relation", "direction")


def narratable_edges(edges: DataFrame) -> DataFrame:
    """V7: edges backed by papers with at least one sentence."""
    told = F.col("n_sentences") > 0 if "n_sentences" in edges.columns else F.exists("source_refs", lambda r: F.coalesce(r["source_sentence"], F.lit("")) != "")
    return edges.where((F.col("provenance_type") == "pmid") & (F.col("pmid_count") >= 1) & told)


def focus_hub(nodes: DataFrame, edges: DataFrame, noise: Column | None = None, graph_key: list[str] = [], ranks: dict[str, int] = TYPE_RANK) -> DataFrame:
    """V8: the best hub of each graph over its narratable edges: 100 per edge, 12 per paper of an edge, 500 if it has both directions,
    25 per rank of its type, 25 for a name of up to 12 characters (runs of others than letters and digits as one blank) or 10 for up to 20, less 1500 for noise.

    Ties go to the node with more papers, then to the shorter name, then to the lesser id.
    """
    half = lambda own, way: F.struct(F.col(own).alias("id"), F.lit(way).alias("way"))
    ends = narratable_edges(edges).select(*graph_key, "pmid_count", F.inline(F.array(half("source", 1), half("target", 0))))
    per = ends.groupBy(*graph_key, "id").agg(F.count("*").alias("incident"), F.sum("pmid_count").alias("papers"), (F.min("way") < F.max("way")).alias("both"))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ranks.items() for x in p)), F.col("type")), F.lit(2))
    size = F.length(F.trim(F.regexp_replace(F.lower("id"), "[^a-z0-9]+", " ")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = 100 * zero("incident") + 12 * zero("papers") + F.when(F.col("both"), 500).otherwise(0) + 25 * rank + F.when(size <= 12, 25).when(size <= 20, 10).otherwise(0)
    if noise is not None:
        score = score - F.when(noise, 1500).otherwise(0)
    rows = nodes.join(per, [*graph_key, "id"], "left").withColumn("score", score)
    best = F.min_by(F.struct("id", "score", zero("incident").alias("incident"), zero("papers").alias("papers")), F.struct(-F.col("score"), -F.col("pmid_count"), F.length("id"), "id"))
    return rows.groupBy(*graph_key).agg(best.alias("h")).select(*graph_key, "h.*")


def hub_summary(edges: DataFrame, hubs: DataFrame, up: int = 3, down: int = 4) -> DataFrame:
    """V9: the strongest incoming and outgoing edges of each hub (column id)."""
    into = edges.join(hubs.select(F.col("id").alias("target")), "target").select(F.col("target").alias("hub"), F.lit("in").alias("direction"), F.col("source").alias("other"), "relation", "pmid_count", "confidence")
    out = edges.join(hubs.select(F.col("id").alias("source")), "source").select(F.col("source").alias("hub"), F.lit("out").alias("direction"), F.col("target").alias("other"), "relation", "pmid_count", "confidence")
    by = Window.partitionBy("hub", "direction").orderBy(F.desc("pmid_count"), F.desc("confidence"), "other", "relation")
    first = lambda side, k: side.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return first(into, up).union(first(out, down))  # a constant limit each: a hub's edges are cut down before they meet


def export_view(nodes: DataFrame, edges: DataFrame, condition: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges that meet a condition, the nodes on them, and a manifest with the filter's text and all counts."""
    e = edges.where(condition)
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    n = nodes.join(ends, "id", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    manifest = count(nodes, "source_nodes").crossJoin(count(edges, "source_edges")).crossJoin(count(n, "exported_nodes")).crossJoin(count(e, "exported_edges"))
    return n, e, manifest.withColumn("filter", F.lit(condition))
