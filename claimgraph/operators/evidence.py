"""Evidence as rows, one for each edge and paper: what edges, nodes and contradictions are counted from without arrays of papers.

A fact is everything that one paper says for one edge. Facts of any number of runs fold by (edge key, paper), so a graph can be kept
as facts and merged run by run (``sources.store``); edges, nodes and pairs are two hash aggregations on them, the first of which
has the paper in its key: a hot edge or hub is counted by many tasks, and no row grows with the number of papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..vocab import ACTIVATE, SUPPRESS
from .graph import _REF, EDGE_KEY, EMPTY_CONTEXT, _flat, prepared_claims

FACT_KEY = [*EDGE_KEY, "paper"]


def edge_facts(claims: DataFrame) -> DataFrame:
    """Claims as facts: a row for each (edge key, paper), ``paper`` empty where a claim names none.

    A claim of several papers is a fact of each; its confidence counts once, with the first.
    """
    # dealt by pair and paper as they are: sets that are begun before the shuffle are longer than the rows
    return folded(fact_parts(claims).repartition("source", "target", "paper"))


def edge_keys(claims: DataFrame) -> DataFrame:
    """The distinct edge keys of claims: what counts edges without their papers. An empty context is null."""
    return prepared_claims(claims).select(*EDGE_KEY).withColumn("context_key", F.nullif("context_key", F.lit(EMPTY_CONTEXT))).distinct()


def node_claims(claims: DataFrame) -> DataFrame:
    """(id, edge_count): how often each node is an end of a claim, as ``counted_nodes`` has it."""
    return prepared_claims(claims).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("edge_count"))


def node_papers(claims: DataFrame) -> DataFrame:
    """(id, pmid_count): the papers of each node, as ``counted_nodes`` has them, from distinct rows of node and paper alone."""
    papers = F.when(F.size("pmids") > 0, F.col("pmids")).otherwise(F.array(F.lit("")))
    rows = prepared_claims(claims).select("source", "target", F.explode(papers).alias("paper")).select(F.explode(F.array("source", "target")).alias("id"), "paper").distinct()
    return rows.groupBy("id").agg(F.count_if(F.col("paper") != "").alias("pmid_count"))


def clashing_pairs(claims: DataFrame, activate: list[str] = ACTIVATE, suppress: list[str] = SUPPRESS) -> DataFrame:
    """A12 without papers and relations: (a, b, kind, side_a, side_b) as ``counted_contradictions`` finds them, by one aggregation with a few flags a pair."""
    rows = prepared_claims(claims).where("source <> target").select("source", "target", F.when(F.col("relation").isin(activate), 1).when(F.col("relation").isin(suppress), 2).alias("sign")).where("sign is not null")
    forth = F.col("source") < F.col("target")
    flags = rows.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.when(forth, F.col("sign")).otherwise(F.col("sign") * 4).alias("sides"))
    bit = {"fp": 1, "fm": 2, "bp": 4, "bm": 8}
    both = lambda kind, x, y: F.when(F.col("sides").bitwiseAND(bit[x] + bit[y]) == bit[x] + bit[y], F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("side_a"), F.lit(y).alias("side_b")))
    found = F.array_compact(F.array(both("same_direction", "fp", "fm"), both("same_direction", "bp", "bm"), both("reverse", "fp", "bm"), both("reverse", "fm", "bp")))
    return flags.groupBy("a", "b").agg(F.bit_or("sides").alias("sides")).select("a", "b", F.explode(found).alias("x")).select("a", "b", "x.*")


def fact_parts(claims: DataFrame) -> DataFrame:
    """Claims as rows that ``folded`` makes facts of."""
    rows = prepared_claims(claims)
    none = F.array().cast(f"array<{_REF}>")
    own = F.struct("pmid", "source_sentence", *(F.lit(None).cast("string").alias(c) for c in ("canonical_id", "source", "source_id", "statement")))
    refs = F.concat(F.coalesce("source_refs", none), F.when(F.coalesce("source_sentence", F.lit("")) != "", F.array(own)).otherwise(none))
    papers = F.when(F.size("pmids") > 0, F.array_distinct("pmids")).otherwise(F.array(F.lit("")))
    rows = rows.withColumn("refs_", refs).select("*", F.posexplode(papers).alias("nth_", "paper"))
    first = F.col("nth_") == 0
    one = lambda c: F.array_compact(F.array(c))
    return rows.select(
        *FACT_KEY, F.array("relation").alias("relations"), one("species").alias("species"), one("evidence_state").alias("evidence_states"), one("session").alias("sessions"),
        F.when(first, F.col("refs_")).otherwise(none).alias("refs"), F.when(first, F.col("confidence")).otherwise(0.0).alias("conf_sum"), F.when(first, 1).otherwise(0).cast("long").alias("conf_n"),
        "source_type", "target_type", F.col("year").alias("first_year"), F.col("year").alias("last_year"), F.col("claim_id").alias("least_id"), F.col("claim_id").alias("greatest_id"), "context",
    )


def folded(facts: DataFrame, *also: str) -> DataFrame:
    """Facts of any number of runs as one for each (edge key, paper): sums, extremes and sets that a paper bounds. ``also`` names columns that follow from the key and stay."""
    return facts.groupBy(*also, *FACT_KEY).agg(
        *(_flat(c).alias(c) for c in ("relations", "species", "evidence_states", "sessions", "refs")),
        F.sum("conf_sum").alias("conf_sum"),
        F.sum("conf_n").alias("conf_n"),
        *(F.min(c).alias(c) for c in ("source_type", "target_type", "first_year", "least_id")),
        *(F.max(c).alias(c) for c in ("last_year", "greatest_id")),
        F.first("context").alias("context"),
    )


def counted_edges(facts: DataFrame) -> DataFrame:
    """B1 in counts: an edge of each key with its papers, sentences, years and means; no arrays of papers."""
    low, high = F.array_min("evidence_states"), F.array_max("evidence_states")
    edges = facts.groupBy(*EDGE_KEY).agg(
        F.min(F.array_min("relations")).alias("relation_"),
        F.count_if(F.col("paper") != "").alias("pmid_count"),
        F.sum(F.size("refs")).alias("n_refs"),
        F.sum(F.size(F.filter("refs", lambda r: F.coalesce(r["source_sentence"], F.lit("")) != ""))).alias("n_sentences"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
        F.sum("conf_sum").alias("conf_sum"),
        F.sum("conf_n").alias("conf_n"),
        F.min("source_type").alias("source_type"),
        F.min("target_type").alias("target_type"),
        F.min(low).alias("low_"),
        F.max(high).alias("high_"),
        F.min("least_id").alias("least_"),
        F.max("greatest_id").alias("greatest_"),
        F.first("context").alias("context"),
    )
    made = T.claim_id(*(F.col(c) for c in EDGE_KEY))
    return edges.select(
        F.when(F.col("least_") == F.col("greatest_"), F.col("least_")).otherwise(made).alias("claim_id"), "source", "target",
        F.when(F.col("relation_key") == "drug_mechanism", F.col("relation_key")).otherwise(F.col("relation_")).alias("relation"), "polarity", "pmid_count", "n_refs", "n_sentences", "first_year", "last_year",
        F.round(F.col("conf_sum") / F.col("conf_n"), 2).alias("confidence"), "conf_sum", "conf_n", T.evidence_strength("pmid_count").alias("evidence_strength"), "source_type", "target_type", "provenance_type",
        F.when(F.col("low_") != F.col("high_"), "mixed").otherwise(F.col("low_")).alias("evidence_state"), "context",
    )


def counted_nodes(facts: DataFrame) -> DataFrame:
    """B2 in counts: both ends of each fact; papers are distinct by (node, paper) before a node's are counted."""
    first = F.concat_ws("\x01", "paper", "source", "target", F.array_min("relations"))
    end = lambda e: F.struct(F.col(e).alias("id"), F.concat(first, F.lit("\x01"), f"{e}_type").alias("first_claim"), F.col(f"{e}_type").alias("type"))
    ends = facts.select("paper", "provenance_type", "conf_n", F.inline(F.array(end("source"), end("target"))))
    per = ends.groupBy("id", "paper").agg(F.min(F.struct("first_claim", "type")).alias("first_"), F.sum("conf_n").alias("edge_count"), F.min("provenance_type").alias("low_"), F.max("provenance_type").alias("high_"))
    nodes = per.groupBy("id").agg(F.min("first_").alias("first_"), F.count_if(F.col("paper") != "").alias("pmid_count"), F.sum("edge_count").alias("edge_count"), F.min("low_").alias("low_"), F.max("high_").alias("high_"))
    return nodes.select("id", "first_.type", "pmid_count", "edge_count", F.when(F.col("low_") == F.col("high_"), F.col("low_")).alias("provenance_type"))


def counted_contradictions(facts: DataFrame, activate: list[str] = ACTIVATE, suppress: list[str] = SUPPRESS) -> DataFrame:
    """A12 in counts: (a, b, kind, side_a, side_b, relations_a, relations_b, n_a, n_b) once per unordered pair and kind, as ``contradictions`` finds them.

    Papers are distinct by (pair, way, sign, paper) before they are counted.
    """
    sign = lambda r: F.when(r.isin(activate), "+").when(r.isin(suppress), "-")
    rows = facts.where("source <> target").select("source", "target", "paper", F.explode("relations").alias("r"))
    rows = rows.withColumn("sign", sign(F.col("r"))).where("sign is not null")
    rows = rows.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.when(F.col("source") < F.col("target"), "f").otherwise("b").alias("way"), "sign", "paper", "r")
    per = rows.groupBy("a", "b", "way", "sign", "paper").agg(F.collect_set("r").alias("r"))
    side = per.groupBy("a", "b", "way", "sign").agg(_flat("r").alias("relations"), F.count_if(F.col("paper") != "").alias("n"))
    cell = lambda way, s: F.max(F.when((F.col("way") == way) & (F.col("sign") == s), F.struct("relations", "n")))
    wide = side.groupBy("a", "b").agg(*(cell(w, s).alias(n) for n, w, s in (("fp", "f", "+"), ("fm", "f", "-"), ("bp", "b", "+"), ("bm", "b", "-"))))

    def pick(kind: str, x: str, y: str):
        one = [F.lit(kind).alias("kind"), F.lit(x).alias("side_a"), F.lit(y).alias("side_b")]
        both = [F.col(f"{c}.{v}").alias(f"{v}_{k}") for v in ("relations", "n") for k, c in (("a", x), ("b", y))]
        return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(*one, *both))

    found = F.array_compact(F.array(pick("same_direction", "fp", "fm"), pick("same_direction", "bp", "bm"), pick("reverse", "fp", "bm"), pick("reverse", "fm", "bp")))
    return wide.select("a", "b", F.explode(found).alias("x")).select("a", "b", "x.*")


def pair_support(facts: DataFrame, watch: DataFrame | None = None) -> DataFrame:
    """(source, target, pmid_count, conf_sum, conf_n): papers of every pair over all its edges; ``watch`` (source, target) keeps its pairs only, before anything is grouped."""
    rows = facts if watch is None else facts.join(watch.select("source", "target").distinct(), ["source", "target"], "left_semi")
    per = rows.groupBy("source", "target", "paper").agg(F.sum("conf_sum").alias("conf_sum"), F.sum("conf_n").alias("conf_n"))
    return per.groupBy("source", "target").agg(F.count_if(F.col("paper") != "").alias("pmid_count"), F.sum("conf_sum").alias("conf_sum"), F.sum("conf_n").alias("conf_n"))
