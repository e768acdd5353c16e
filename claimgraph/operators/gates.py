"""Claim gates (G1-G3): every claim keeps an ordered array of reasons; empty means accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..vocab import CONTEXT_MARKERS, KNOWN_NODE_TYPES, RELATION_CUES


def quality_gate(claims: DataFrame, anchors: list[str], pubs: DataFrame) -> DataFrame:
    """G1: adds ``reasons``. Anchors must occur in the first paper's title or abstract, or in the claim's ends."""
    ids = F.filter(F.coalesce("pmids", F.when(F.coalesce("pmid", F.lit("")) != "", F.array("pmid")).otherwise(F.array().cast("array<string>"))), lambda p: p.isNotNull() & (p != ""))
    rows = claims.withColumn("ids_", ids).withColumn("first_", F.try_element_at("ids_", F.lit(1)))

    def anchored(text: Column) -> Column:
        out = F.lit(False)
        for a in filter(None, anchors):
            out = out | T.entity_mentioned(F.lit(a), text)
        return out

    papers = pubs.select(F.col("pmid").alias("first_"), anchored(F.concat_ws(" ", "title", "abstract")).alias("paper_ok_")).dropDuplicates(["first_"])
    rows = rows.join(papers, "first_", "left")
    sentence = F.coalesce("source_sentence", F.lit(""))
    mentioned = T.entity_mentioned("source", sentence) & T.entity_mentioned("target", sentence)
    known = F.coalesce(F.col("source_type").isin(KNOWN_NODE_TYPES) & F.col("target_type").isin(KNOWN_NODE_TYPES), F.lit(False))
    provenance = F.coalesce("provenance_type", F.when(F.size("ids_") > 0, "pmid").otherwise("unknown"))
    relevant = F.coalesce("paper_ok_", F.lit(False)) | anchored(F.concat_ws(" ", "source", "target"))
    reasons = F.array_compact(
        F.array(
            F.when(F.size("ids_") == 0, "missing_pmid"),
            F.when(sentence == "", "missing_source_sentence").when(~mentioned, "endpoints_not_in_source_sentence"),
            F.when(~known, "unknown_node_type"),
            F.when(provenance != "pmid", "non_pmid_provenance"),
            F.when(~relevant, "target_relevance_not_demonstrated"),
        )
    )
    return rows.withColumn("reasons", reasons).drop("ids_", "first_", "paper_ok_")


def semantic_gate(claims: DataFrame, context_terms: list[str] = (), cues: dict[str, str] = RELATION_CUES, compat: bool = False) -> DataFrame:
    """Adds ``reasons``: the relation's cue must occur in the sentence, and tissue or cell ends need context.

    Any context term counts; ``compat`` asks for all of them run together.
    """
    sentence = F.coalesce("source_sentence", F.lit(""))
    low, relation = F.lower(sentence), F.lower(F.coalesce("relation", F.lit("")))
    cue = F.lit(True)
    for name, pattern in cues.items():
        cue = F.when(relation == name, low.rlike(pattern)).otherwise(cue)
    place = F.col("source_type").isin("Tissue", "Cell", "Cell_type") | F.col("target_type").isin("Tissue", "Cell", "Cell_type")
    named = F.lit(False)
    for t in [" ".join(context_terms)] if compat and context_terms else context_terms:
        named = named | T.entity_mentioned(F.lit(t), sentence)
    context = F.lit(bool(context_terms)) & F.coalesce(place, F.lit(False)) & ~(named | low.rlike(CONTEXT_MARKERS))
    return claims.withColumn("reasons", F.array_compact(F.array(F.when(~cue, "causal_direction_not_supported"), F.when(context, "tissue_cell_context_not_supported"))))


def split_gate(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a gate."""
    return gated.where("size(reasons) = 0").drop("reasons"), gated.where("size(reasons) > 0")


def gate_report(gated: DataFrame) -> DataFrame:
    """Claims per reason; ``accepted`` for those without one."""
    reason = F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("accepted"))).otherwise(F.col("reasons")))
    return gated.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def gated_with_fallback(primary: DataFrame, fallback: DataFrame, least: int = 3) -> DataFrame:
    """Accepted claims of a run, with the accepted fallback claims where the primary ones are fewer than ``least``."""
    ok, more = split_gate(primary)[0], split_gate(fallback)[0]
    enough = ok.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("run_id")
    return ok.unionByName(more.join(enough, "run_id", "left_anti"), allowMissingColumns=True)
