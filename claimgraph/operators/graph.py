"""Graph build, merge and overlays (B1-B11). Graphs are pairs of DataFrames (nodes, edges)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..vocab import COMPATIBLE_TYPES, NODE_LABELS

NO_CONTEXT = "named_struct('cell_types', array(), 'disease', array(), 'drugs', array(), 'tissues', array())"
EDGE_KEY = ["source", "target", "relation_key", "polarity", "context_key", "provenance_type"]


def canonical_node_label(label: Column, node_type: Column) -> Column:
    """Role-scoped alias of a label, else the label: the same spelling in another role stays apart.

    Only labels of a role with aliases that have the first character of one of them are looked up.
    """
    pairs = [F.lit(x) for (kind, key), name in NODE_LABELS.items() for x in (f"{kind}|{key}", name)]
    may = F.lit(False)
    for role, first in sorted({(kind, key[0]) for kind, key in NODE_LABELS}):
        may = may | ((node_type == role) & F.contains(F.lower(label), F.lit(first)))
    return F.when(may, F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(node_type, F.lit("|"), T.compact_label(label))), label)).otherwise(label)


def _context(c: str = "context") -> Column:
    fields = [F.coalesce(F.col(f"{c}.{f}"), F.array().cast("array<string>")).alias(f) for f in ("cell_types", "disease", "drugs", "tissues")]
    return F.struct(*fields)


#: The JSON of a context without anything, as ``to_json`` writes it.
EMPTY_CONTEXT = '{"cell_types":[],"disease":[],"drugs":[],"tissues":[]}'


def _context_key() -> Column:
    bare = F.lit(True)
    for f in ("cell_types", "disease", "drugs", "tissues"):
        bare = bare & (F.size(f"context.{f}") == 0)
    return F.when(bare, F.lit(EMPTY_CONTEXT)).otherwise(F.to_json("context"))


def prepared_claims(claims: DataFrame) -> DataFrame:
    """Claims with all defaults of the graph build filled in and the edge key's parts added."""
    kind = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    out = claims.withColumns({"source_type": kind("source_type"), "target_type": kind("target_type")})
    # labels come out of a generator, so that each is made once a row: conditions on them would repeat them all
    labels = F.struct(*(canonical_node_label(F.col(e), F.col(f"{e}_type")).alias(e) for e in ("source", "target")))
    out = out.select(*(c for c in out.columns if c not in ("source", "target")), F.inline(F.array(labels)))
    out = out.where("source <> '' and target <> ''")
    relation = F.coalesce("relation", F.lit("related"))
    own = F.when(F.coalesce("pmid", F.lit("")) != "", F.array("pmid")).otherwise(F.array().cast("array<string>"))
    out = out.withColumns(
        {
            "relation": relation,
            "pmids": F.filter(F.coalesce("pmids", own), lambda p: p.isNotNull() & (p != "")),
            "species": F.coalesce("species", F.lit("unknown")),
            "confidence": F.coalesce("confidence", F.lit(0.5)),
            "provenance_type": F.coalesce("provenance_type", F.when(F.coalesce("pmid", F.lit("")) != "", "pmid").otherwise("unknown")),
            "context": _context(),
            "evidence_state": F.coalesce("evidence_state", F.when(relation == "indirectly_modulates", "indirect_chain").otherwise("literature_direct")),
        }
    )
    mechanism = (F.col("source_type") == "Drug") & F.col("relation").isin("binds_target", "indirectly_modulates")
    return out.withColumns({"relation_key": F.when(mechanism, "drug_mechanism").otherwise(F.col("relation")), "context_key": _context_key()})


def _flat(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


_REF = "struct<pmid:string,source_sentence:string,canonical_id:string,source:string,source_id:string,statement:string>"


def edge_parts(claims: DataFrame) -> DataFrame:
    """Claims as rows that ``merged_edges`` folds: an edge of one observation each."""
    rows = prepared_claims(claims)
    none = F.array().cast(f"array<{_REF}>")
    own_ref = F.struct("pmid", "source_sentence", *(F.lit(None).cast("string").alias(c) for c in ("canonical_id", "source", "source_id", "statement")))
    refs = F.concat(F.coalesce("source_refs", none), F.when(F.coalesce("source_sentence", F.lit("")) != "", F.array(own_ref)).otherwise(none))
    one = lambda c: F.array_compact(F.array(c))
    return rows.select(
        *EDGE_KEY, F.array("relation").alias("relations"), "pmids", one("year").alias("years"), one("species").alias("species"), F.col("confidence").alias("conf_sum"), F.lit(1).alias("conf_n"),
        "source_type", "target_type", one("evidence_state").alias("evidence_states"), one("session").alias("sessions"), refs.alias("source_refs"), "context", one("claim_id").alias("ids_"),
    )


def parts_of_edges(edges: DataFrame, mode: str = "exact") -> DataFrame:
    """Edges of a graph as rows that ``merged_edges`` folds; ``compat`` counts an edge as one observation of its mean."""
    sums = ("conf_sum", "conf_n") if mode == "exact" else ("confidence", "1")
    return edges.select(
        "source", "target", F.col("relation").alias("relation_key"), "polarity", F.to_json("context").alias("context_key"), "provenance_type", "relations", "pmids", "years", "species", F.expr(sums[0]).alias("conf_sum"), F.expr(sums[1]).alias("conf_n"),
        "source_type", "target_type", "evidence_states", "sessions", "source_refs", "context", F.array_compact(F.array("claim_id")).alias("ids_"),
    )


def merged_edges(parts: DataFrame) -> DataFrame:
    """Rows of any number of runs folded by their edge key: one hash aggregation with map-side partials.

    Every column is a sum, a set or a minimum, so the order of merges doesn't matter.
    """
    edges = parts.groupBy(*EDGE_KEY).agg(
        *(_flat(c).alias(c) for c in ("relations", "pmids", "years", "species")),
        F.sum("conf_sum").alias("conf_sum"),
        F.sum("conf_n").alias("conf_n"),
        F.min("source_type").alias("source_type"),
        F.min("target_type").alias("target_type"),
        *(_flat(c).alias(c) for c in ("evidence_states", "sessions", "source_refs", "ids_")),
        F.first("context").alias("context"),
    )
    made = T.claim_id(*(F.col(c) for c in EDGE_KEY))
    return edges.select(
        F.when(F.size("ids_") == 1, F.col("ids_")[0]).otherwise(made).alias("claim_id"),
        "source",
        "target",
        F.when(F.col("relation_key") == "drug_mechanism", F.col("relation_key")).otherwise(F.col("relations")[0]).alias("relation"),
        "relations",
        "polarity",
        "pmids",
        F.size("pmids").alias("pmid_count"),
        "years",
        "species",
        F.round(F.col("conf_sum") / F.col("conf_n"), 2).alias("confidence"),
        "conf_sum",
        "conf_n",
        T.evidence_strength(F.size("pmids")).alias("evidence_strength"),
        "source_type",
        "target_type",
        "provenance_type",
        F.when(F.size("evidence_states") > 1, "mixed").otherwise(F.col("evidence_states")[0]).alias("evidence_state"),
        "evidence_states",
        "sessions",
        "source_refs",
        "context",
    )


def build_edges(claims: DataFrame) -> DataFrame:
    """B1: one edge per (source, target, relation key, polarity, context, provenance); opposite claims stay apart.

    conf_sum and conf_n keep means exact over later merges. Papers and sentences are arrays here, as graph documents have them;
    ``evidence`` counts them without.
    """
    return merged_edges(edge_parts(claims))


def build_nodes(claims: DataFrame) -> DataFrame:
    """B2: both ends of each claim; the type is that of the first claim by (pmid, source, target, relation), kept as ``first_claim``."""
    rows = prepared_claims(claims)
    first = F.concat_ws("\x01", F.coalesce("pmid", F.lit("")), "source", "target", "relation")
    end = lambda e: F.struct(F.col(e).alias("id"), F.concat(first, F.lit("\x01"), f"{e}_type").alias("first_claim"), F.col(f"{e}_type").alias("type"))
    parts = rows.select("pmids", F.array("provenance_type").alias("provenance_types"), F.lit(1).alias("edge_count"), F.inline(F.array(end("source"), end("target"))))
    return merged_nodes(parts)


def merged_nodes(parts: DataFrame) -> DataFrame:
    """Nodes of any number of runs folded by their id."""
    nodes = parts.groupBy("id").agg(
        F.min_by("type", "first_claim").alias("type"),
        F.min("first_claim").alias("first_claim"),
        _flat("pmids").alias("pmids"),
        F.sum("edge_count").cast("int").alias("edge_count"),
        _flat("provenance_types").alias("provenance_types"),
    )
    single = F.when(F.size("provenance_types") == 1, F.col("provenance_types")[0])
    return nodes.select("id", "type", F.size("pmids").alias("pmid_count"), "pmids", "edge_count", single.alias("provenance_type"), "provenance_types", "first_claim")


def merge_graph(prior_nodes: DataFrame, prior_edges: DataFrame, claims: DataFrame, mode: str = "exact") -> tuple[DataFrame, DataFrame]:
    """New claims folded into a prior graph; nodes without edges stay.

    Prior edges are rows of the same aggregation as new claims: nothing is exploded or joined, and a prior row without a match passes as
    it is. ``exact`` keeps sums and counts of confidences, so the order of merges doesn't matter; ``compat`` counts a
    prior edge as one observation. ``sources.store`` keeps a graph in buckets and merges only those that new claims touch.
    """
    edges = merged_edges(parts_of_edges(prior_edges, mode).unionByName(edge_parts(claims)))
    cols = ["id", "type", "first_claim", "pmids", "edge_count", "provenance_types"]
    old = prior_nodes if "first_claim" in prior_nodes.columns else prior_nodes.withColumn("first_claim", F.lit(""))  # a stored type stays
    return merged_nodes(old.select(cols).unionByName(build_nodes(claims).select(cols))), edges


def contract_filter(graphs: DataFrame, catalog: DataFrame, contract: str) -> DataFrame:
    """Rows of graphs whose catalog entry has the same quality contract."""
    return graphs.join(catalog.where(F.col("quality_contract") == contract).select("graph_id"), "graph_id", "left_semi")


def fold_canonical(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """Canonical nodes that aren't in the graph, with no papers and canonical provenance."""
    new = canonical.select(F.explode("nodes").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    empty = F.array().cast("array<string>")
    new = new.select("id", F.lit("canonical_db").alias("type"), F.lit(0).alias("pmid_count"), empty.alias("pmids"), F.lit(0).alias("edge_count"), F.lit("canonical_db").alias("provenance_type"), F.array(F.lit("canonical_db")).alias("provenance_types"))
    return nodes.unionByName(new, allowMissingColumns=True)


def canonical_overlay(canonical: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One hub per canonical entry, and its edges to nodes that exist."""
    hub = F.concat(F.lit("__canonical__"), "entry_id")
    hubs = canonical.select(hub.alias("id"), F.lit("canonical_db").alias("type"), F.col("statement").alias("label"))
    edges = canonical.select(hub.alias("source"), F.explode("nodes").alias("target"), "statement", "source_id").distinct()
    edges = edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return hubs, edges.select("source", "target", F.lit("canonical_supports_context").alias("relation"), F.lit("canonical").alias("evidence_strength"), "statement", "source_id")


def target_dimensions(targets: DataFrame) -> DataFrame:
    """(run_id, pos, dimension, value) of everything a target asks for, in order."""
    one = lambda name, kind, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("dimension"), F.lit(kind).alias("type"), v.alias("value")))
    parts = [one("disease", "Disease", F.array_compact(F.array("disease")))] + [one(n, k, F.col(n)) for n, k in (("genes", "Gene"), ("drugs", "Drug"), ("tissues", "Tissue"), ("cell_types", "Cell_type"))]
    return targets.select("run_id", F.posexplode(F.concat(*parts)).alias("pos", "d")).select("run_id", "pos", "d.*")


def input_only_nodes(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Placeholders for requested values that no node has, with ids ``__input__type__key``."""
    asked = target_dimensions(targets).withColumn("key", T.compact_label("value")).where("key <> ''")
    have = nodes.select(T.compact_label("id").alias("key")).distinct()
    lone = asked.join(have, "key", "left_anti")
    return lone.select("run_id", F.concat(F.lit("__input__"), F.lower("type"), F.lit("__"), "key").alias("id"), F.col("value").alias("label"), "type", F.lit("input_only").alias("provenance_type")).distinct()


def semantic_types(nodes: DataFrame, targets: DataFrame, compatible: dict[str, list[str]] = COMPATIBLE_TYPES) -> DataFrame:
    """The requested type of nodes with a compatible base type and an equal key; the first dimension wins. Nodes of a
    canonical source and of unknown types keep their type."""
    ok = F.create_map(*(x for k, v in compatible.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    asked = target_dimensions(targets).select(T.compact_label("value").alias("key"), F.col("type").alias("asked"), "pos").where("key <> ''").distinct()
    hits = nodes.withColumn("key", T.compact_label("id")).join(asked, "key").where(F.array_contains(ok[F.col("asked")], F.col("type")))
    best = hits.groupBy("id").agg(F.min_by("asked", "pos").alias("asked"))
    out = nodes.join(best, "id", "left")
    return out.withColumn("display_type", F.coalesce("asked", "type")).drop("asked")


def summary_view(nodes: DataFrame, edges: DataFrame, sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """Serving form with counts and at most ``sample`` ids and exact sentences."""
    refs = F.filter("source_refs", lambda r: F.coalesce(r["source_sentence"], F.lit("")) != "")
    n = nodes.withColumn("pmid_sample", F.slice("pmids", 1, sample)).drop("pmids")
    e = edges.select("claim_id", "source", "target", "relation", "pmid_count", F.slice("pmids", 1, sample).alias("pmid_sample"), F.slice(F.transform(refs, lambda r: r["source_sentence"]), 1, sample).alias("sentences"), F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target")).alias("contradiction_group"))
    return n, e


def clean_noise(nodes: DataFrame, edges: DataFrame, artifact: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drops artifact nodes (a condition on ``id``) and their edges, rebuilds node counts, and tells what went."""
    bad = nodes.where(artifact).select("id")
    kept = edges.join(bad, edges.source == bad.id, "left_anti").join(bad, edges.target == bad.id, "left_anti")
    ends = kept.select(F.explode(F.array("source", "target")).alias("id"), "pmids").groupBy("id").agg(F.count("*").cast("int").alias("edge_count"), _flat("pmids").alias("pmids"))
    left = nodes.join(bad, "id", "left_anti").drop("edge_count", "pmids", "pmid_count").join(ends, "id", "left")
    empty = F.array().cast("array<string>")
    left = left.withColumns({"edge_count": F.coalesce("edge_count", F.lit(0)), "pmids": F.coalesce("pmids", empty)}).withColumn("pmid_count", F.size("pmids"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    audit = count(nodes, "nodes_before").crossJoin(count(left, "nodes_after")).crossJoin(count(edges, "edges_before")).crossJoin(count(kept, "edges_after"))
    return left, kept, audit


def drug_gene_states(targets: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence state of every requested (drug, gene), never promoting missing evidence.

    ``claims``: drug, predicate, object, target, target_type, claim_id, source_sentence.
    """
    pairs = targets.select("run_id", F.explode("drugs").alias("drug"), "genes", "statistical_candidates").select("run_id", "drug", F.explode("genes").alias("gene"), "statistical_candidates")
    c = claims.select(F.lower("drug").alias("drug_key"), "predicate", "object", F.col("target").alias("c_target"), "target_type", "claim_id", "source_sentence")
    joined = pairs.withColumn("drug_key", F.lower("drug")).join(c, "drug_key", "left")
    gene = F.lower("gene")
    named = F.contains(F.lower("object"), gene)
    direct = (F.col("predicate") == "binds_target") & named
    chain = (F.col("predicate") == "indirectly_modulates") & (named | ((F.col("target_type") == "Pathway") & F.contains(F.lower("source_sentence"), gene)))
    via = F.when(chain & (F.col("target_type") == "Pathway"), F.col("c_target"))
    stat = F.exists(F.coalesce("statistical_candidates", F.array()), lambda s: (F.lower(s["drug"]) == F.lower("drug")) & (F.lower(s["gene"]) == F.lower("gene")))
    out = joined.withColumn("stat", stat).groupBy("run_id", "drug", "gene").agg(
        F.bool_or("stat").alias("stat"),
        F.coalesce(F.bool_or(direct), F.lit(False)).alias("direct"),
        F.coalesce(F.bool_or(chain), F.lit(False)).alias("chain"),
        F.array_sort(F.collect_set(F.when(direct, F.col("claim_id")))).alias("direct_claims"),
        F.array_sort(F.collect_set(F.when(chain, F.col("claim_id")))).alias("chain_claims"),
        F.array_sort(F.collect_set(via)).alias("intermediate_targets"),
    )
    yes = lambda c, no: F.when(F.col(c), "supported").otherwise(no)
    return out.select("run_id", "drug", "gene", yes("stat", "not_provided").alias("candidate_statistical"), yes("direct", "not_found").alias("literature_direct"), yes("chain", "not_found").alias("indirect_chain"), F.when(F.col("direct") | F.col("chain"), "not_applicable").otherwise("active").alias("no_literature_support"), "direct_claims", "chain_claims", "intermediate_targets")
