"""Candidates, novelty classes, audits and reviews (H1-H9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .analytics import numbered
from .corpus import search_corpus
from .iterate import staged


def candidate_manifest(contradictions: DataFrame, gaps: DataFrame, runs: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """H1: per run, contradictions C001.. by pair and gaps G00n, numbered on, then curated candidates with their own ids; a run without any has one fallback.

    Inputs: contradictions (run_id, a, b; a null end: a contradiction without a pair), gaps (run_id, architecture, missing_edge), runs (run_id, disease),
    curated (run_id, candidate_id, statement). A gap without a missing edge takes a number and gives no row. Numbers come from value ranges over all
    executors, so a run may have any number of candidates.
    """
    null = F.lit(None).cast("string")
    c = contradictions.select("run_id", F.lit(0).alias("part"), "a", "b", null.alias("architecture"), null.alias("missing_edge"))
    g = gaps.select("run_id", F.lit(1).alias("part"), null.alias("a"), null.alias("b"), "architecture", "missing_edge")
    rows = numbered(staged(c.union(g), "candidates"), ["run_id", "part", "a", "b", "architecture", "missing_edge"], "at")
    rows = staged(rows, "candidates")
    before = rows.groupBy("run_id").agg(F.min("at").alias("before"))
    rows = rows.join(before, "run_id").join(runs.select("run_id", "disease").dropDuplicates(["run_id"]), "run_id", "left").withColumn("n", F.col("at") - F.col("before") + 1)
    disease = F.coalesce("disease", F.lit(""))
    open_ = F.concat(F.lit("Which condition determines whether "), "a", F.lit(" -> "), "b", F.lit(" or the reverse dominates?"))
    clash = F.coalesce(open_, F.concat(F.lit("Resolve contradiction "), F.col("n").cast("string"), F.lit(" in "), disease))
    gap = F.concat("missing_edge", F.lit(" in "), disease, F.lit(" ("), F.coalesce("architecture", F.lit("global")), F.lit(")"))
    first = F.col("part") == 0
    rows = rows.where("part = 0 or coalesce(missing_edge, '') <> ''")
    out = rows.select("run_id", F.concat(F.when(first, "C").otherwise("G"), T.padded("n")).alias("candidate_id"), F.when(first, clash).otherwise(gap).alias("statement"), F.when(first, "contradiction").otherwise("gap").alias("kind"))
    if curated is not None:
        out = out.unionByName(curated.select("run_id", "candidate_id", "statement", F.lit("curated").alias("kind")))
    bare = runs.select("run_id", "disease").dropDuplicates(["run_id"]).join(out.select("run_id"), "run_id", "left_anti")
    fallback = F.concat(F.lit("Mechanistic gap candidates in "), F.coalesce("disease", F.lit("")))
    return out.unionByName(bare.select("run_id", F.lit("G001").alias("candidate_id"), fallback.alias("statement"), F.lit("fallback").alias("kind")))


def normalized(c: Column | str) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(T.col(c).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def labels_with(labels: DataFrame, terms: DataFrame, size: int = 3) -> DataFrame:
    """(term, label) where the label has the term in normalised form: terms (term) meet labels (label) on their rarest run of ``size`` characters, then
    the whole term is looked for. Shorter terms meet on themselves; a term that normalises to nothing is in every label.

    Only labels are cut into runs, each run once; no term is compared with labels that lack its rarest run.
    """
    l = labels.select("label").distinct().withColumn("l_", normalized("label"))
    t = terms.select("term").distinct().withColumn("t_", normalized("term"))
    runs = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.lit("")), *(runs(F.col("l_"), n) for n in range(1, size + 1)))
    grams = l.select("label", "l_", F.explode(F.array_distinct(every)).alias("run"))
    own = F.when(F.length("t_") >= size, F.array_distinct(runs(F.col("t_"), size))).otherwise(F.array("t_"))
    asked = t.select("term", "t_", F.explode(own).alias("run"))
    often = grams.join(asked.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    anchors = asked.join(often, "run", "left").groupBy("term", "t_").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("x"))
    return anchors.select("term", "t_", F.col("x.run").alias("run")).join(grams, "run").where(F.contains("l_", F.col("t_"))).select("term", "label")


def pattern_edges(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """H2 in rows: (pattern_id, source, target, relation, pmid_count, pmids) of the edges that both terms of one of a pattern's hops (pattern_id,
    source_term, target_term) occur in, each once a pattern. A term that many labels have gives rows, never a longer one.
    """
    sides = {}
    for e in ("source", "target"):
        sides[e] = labels_with(edges.select(F.col(e).alias("label")), patterns.select(F.col(f"{e}_term").alias("term"))).select(F.col("term").alias(f"{e}_term"), F.col("label").alias(e))
    hops = patterns.select("pattern_id", "source_term", "target_term").distinct()
    hits = hops.join(sides["source"], "source_term").join(edges, "source").join(sides["target"], ["target_term", "target"])
    return hits.groupBy("pattern_id", "source", "target", "relation").agg(F.max("pmid_count").cast("long").alias("pmid_count"), F.first("pmids").alias("pmids"))


def pattern_counts(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """H2: edges and distinct papers of each pattern, zeros without any; ``found`` are its ``pattern_edges``."""
    per = found.groupBy("pattern_id").agg(F.count("*").alias("edges"))
    papers = found.select("pattern_id", F.explode("pmids").alias("pmid")).distinct().groupBy("pattern_id").agg(F.count("*").alias("pmid_count"))
    out = patterns.select("pattern_id").distinct().join(per, "pattern_id", "left").join(papers, "pattern_id", "left")
    return out.select("pattern_id", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("pmid_count", F.lit(0)).alias("pmid_count"))


def supported_patterns(edges: DataFrame, patterns: DataFrame, sample: int = 3) -> DataFrame:
    """H2 as a document has it: ``pattern_counts`` with all summaries (and their first pmids) in an array. For patterns of few edges; ``pattern_edges`` has the same in rows.
    """
    one = pattern_edges(edges, patterns)
    summary = F.struct("source", "target", "relation", "pmid_count", F.slice("pmids", 1, sample).alias("sample_pmids"))
    per = one.groupBy("pattern_id").agg(F.array_sort(F.collect_list(summary)).alias("supporting_edges"))
    none = F.array().cast("array<struct<source:string,target:string,relation:string,pmid_count:bigint,sample_pmids:array<string>>>")
    return pattern_counts(one, patterns).join(per, "pattern_id", "left").select("pattern_id", "edges", "pmid_count", F.coalesce("supporting_edges", none).alias("supporting_edges"))


def eligible(audits: DataFrame, candidates: DataFrame) -> DataFrame:
    """H3: explicitly eligible audits; runs without any take curated candidates with 2 edges and 2 papers as class D."""
    yes = audits.where("eligible").select("run_id", "candidate_id", "classification", F.lit("audit").alias("origin"))
    rest = candidates.where("edges >= 2 and pmid_count >= 2").join(yes.select("run_id"), "run_id", "left_anti")
    return yes.union(rest.select("run_id", "candidate_id", F.lit("D"), F.lit("curated")))


def restated(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """H4: candidates (candidate_id, source, target per hop): RESTATED where one paper supports every hop, else how many do any."""
    total = hops.groupBy("candidate_id").agg(F.count_distinct("source", "target").alias("total"))
    got = hops.join(edges, ["source", "target"]).select("candidate_id", "source", "target", F.explode("pmids").alias("pmid")).distinct()
    per = got.groupBy("candidate_id", "pmid").agg(F.count("*").alias("n")).join(total, "candidate_id")
    out = per.groupBy("candidate_id").agg(F.max(F.col("n") == F.col("total")).alias("one"), F.count("*").alias("papers"))
    verdict = F.when(F.col("one"), "RESTATED").when(F.col("papers") >= 2, "independent").otherwise("insufficient")
    return total.select("candidate_id").join(out, "candidate_id", "left").select("candidate_id", F.coalesce(verdict, F.lit("insufficient")).alias("verdict"), F.coalesce("papers", F.lit(0)).alias("papers"))


def evidenced_hops(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, hops, evidenced): distinct hops (candidate_id, source, target) of each candidate, and how many have an edge."""
    own = hops.select("candidate_id", "source", "target").distinct()
    have = edges.select("source", "target").distinct().withColumn("e_", F.lit(1))
    return own.join(have, ["source", "target"], "left").groupBy("candidate_id").agg(F.count("*").alias("hops"), F.count("e_").alias("evidenced"))


def chain_hits(candidates: DataFrame, corpora: list[DataFrame]) -> DataFrame:
    """(candidate_id, hits): in how many texts of each corpus (pmid, title, abstract, year) all of a candidate's groups of words (any-of each) occur.

    The search of C15, one for each corpus, whole chains at once.
    """
    out = candidates.select("candidate_id").distinct()
    asked = candidates.select(F.col("candidate_id").alias("strategy"), "groups", F.lit(-9999).alias("year_from"), F.lit(9999).alias("year_to"))
    for k, pubs in enumerate(corpora):
        totals, _ = search_corpus(pubs.withColumn("year", F.coalesce("year", F.lit(0))), asked)
        out = out.join(totals.select(F.col("strategy").alias("candidate_id"), F.col("total").alias(f"h{k}")), "candidate_id", "left")
    return out.select("candidate_id", F.array(*(F.coalesce(f"h{k}", F.lit(0)) for k in range(len(corpora)))).cast("array<long>").alias("hits"))


def novelty_class(candidates: DataFrame, many: int = 100, some: int = 50) -> DataFrame:
    """H5: class from canonical match, hits of the whole chain (array, one per searched corpus), conflict and hops (hops, evidenced).

    In this order: no logged search is invalid; a canonical match or more than ``many`` hits A, more than ``some`` B, conflicting C; no hit in two
    corpora or more E; some hops evidenced, but not all, D. What is left has a hit (B: the chain is published) or was looked for in one corpus
    alone (invalid).
    """
    most = F.array_max("hits")
    partly = (F.col("evidenced") > 0) & (F.col("evidenced") < F.col("hops"))
    return candidates.withColumn(
        "class",
        F.when(F.coalesce(F.size("hits"), F.lit(0)) < 1, "invalid")
        .when(F.col("canonical") | (most > many), "A")
        .when(most > some, "B")
        .when(F.col("conflicting"), "C")
        .when((F.size("hits") >= 2) & (most == 0), "E")
        .when(partly, "D")
        .when(most > 0, "B")
        .otherwise("invalid"),
    )


def contradictions_for(hypotheses: DataFrame, contradictions: DataFrame, most: int = 10, default: int = 5) -> DataFrame:
    """H6: contradictions (a, b) that touch the nodes of a hypothesis' edges ("x->y"), at most ``most``; else the first ``default``."""
    nodes = hypotheses.select("hypothesis_id", F.explode(F.flatten(F.transform("edges", lambda e: F.transform(F.split(e, "->|→"), F.trim)))).alias("node")).distinct()
    c = staged(contradictions.select("a", "b").distinct(), "contradictions")
    ends = c.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    hit = nodes.join(ends, "node").select("hypothesis_id", "a", "b").distinct()
    hit = hit.withColumn("n", F.row_number().over(Window.partitionBy("hypothesis_id").orderBy("a", "b"))).where(F.col("n") <= most)
    first = c.orderBy("a", "b").limit(default)
    rest = hypotheses.select("hypothesis_id").join(hit.select("hypothesis_id").distinct(), "hypothesis_id", "left_anti").crossJoin(F.broadcast(first))
    return hit.select("hypothesis_id", "a", "b", F.lit("touches").alias("origin")).union(rest.select("hypothesis_id", "a", "b", F.lit("default")))


def review_outcomes(reviews: DataFrame) -> DataFrame:
    """H7: per hypothesis: accepted unless the consensus rejects; ACCEPT votes count only with a logged search."""
    rejected = F.upper(F.col("consensus")).isin("REJECT", "REJECTED")
    valid = (F.upper("vote") == "ACCEPT") & (F.coalesce("query", F.lit("")) != "")
    return reviews.groupBy("run_id", "hypothesis_id").agg((~F.coalesce(F.max(rejected), F.lit(False))).alias("accepted"), F.count_if(valid).alias("valid_accepts"), F.count_distinct("query").alias("distinct_queries"), F.count_distinct("reviewer").alias("reviewers"))


def transcript_text(text: Column) -> Column:
    """Text without repeated escaping: up to three rounds of quotes and backslashes."""
    plain = F.coalesce(text, F.lit(""))
    for _ in range(3):
        plain = F.replace(F.replace(plain, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return plain


def field_values(text: Column, field: str, value: str, quoted: bool = True) -> Column:
    """All values of ``field`` in transcript text: the field's name, a colon and the value, with or without quotes around both."""
    quote = "['\"]" if quoted else "['\"]?"
    return F.regexp_extract_all(text, F.lit(rf"{field}['\"]?\s*:\s*{quote}\s*({value})" if not quoted else rf"{field}['\"]?\s*:\s*{quote}({value})"), F.lit(1))


def last_field(text: Column, field: str, value: str, quoted: bool = True) -> Column:
    """H8: the last value of a field, else null."""
    return F.try_element_at(field_values(text, field, value, quoted), F.lit(-1))


def _any(n: int) -> str:
    return rf"[^'\"]{{1,{n}}}"


def parse_audit_text(rows: DataFrame, column: str = "result_text", fallback: str | None = None) -> DataFrame:
    """H8: classification, eligibility, statement, hypothesis id and action out of transcript text; the last value of a field counts.

    ``fallback`` names a column with the candidate's label: where the transcript has no statement of its own, that is said.
    """
    text = transcript_text(F.col(column))
    statement = last_field(text, "original_statement", _any(500))
    if fallback is not None:
        label = F.col(fallback)
        generic = statement.isNull() | (F.lower(F.trim(statement)) == F.lower(F.trim(label)))
        named = F.try_element_at(F.regexp_extract_all(text, F.lit(r"as a previously published ([^,;]{1,300}mechanism)"), F.lit(1)), F.lit(-1))
        own = F.when(named.isNotNull(), F.concat(F.lit("Candidate mechanism: "), named)).when(label.isNotNull(), F.concat(F.lit("No concrete mechanistic hypothesis supplied. Candidate label: "), label))
        statement = F.when(generic, F.coalesce(own, statement)).otherwise(statement)
    return rows.withColumns(
        {
            "classification": last_field(text, "classification", "A|B|C|D|E|RESTATED", quoted=False),
            "eligible": F.coalesce(last_field(text, "eligible_for_hypothesis_generation", "true|false", quoted=False) == "true", F.lit(False)),
            "statement": statement,
            "hypothesis_id": last_field(text, "hypothesis_id", r"[^'\"]+"),
            "action": last_field(text, "action", _any(700)),
        }
    )


def parse_hypothesis_text(rows: DataFrame, column: str = "result_text") -> DataFrame:
    """H8: id, class, source gap, prediction and falsification of a hypothesis; rows without any of them go."""
    text = transcript_text(F.col(column))
    fields = {"class": "class", "source_gap": "source_gap", "specific_prediction": "specific_prediction", "falsification": "falsification"}
    own = F.coalesce(last_field(text, "id", r"H[-A-Za-z0-9_]+"), last_field(text, "hypothesis_id", r"[^'\"]+"))
    out = rows.withColumns({"id": own} | {k: last_field(text, v, _any(1200)) for k, v in fields.items()})
    return out.where(F.coalesce("id", *fields).isNotNull())


def parse_experiment_text(rows: DataFrame, column: str = "result_text") -> DataFrame:
    """H8: one row per experiment id of a transcript; methods, outcomes and criteria are aligned by position."""
    text = transcript_text(F.col(column))
    names = {"id": ("id", r"E[-A-Za-z0-9_]+"), "method": ("method", _any(1800)), "predicted_outcome": ("predicted_outcome", _any(1800)), "falsification_criterion": ("falsification_criterion", _any(1800))}
    found = rows.withColumns({f"{k}_": field_values(text, *v) for k, v in names.items()})
    at = lambda k: F.try_element_at(F.col(f"{k}_"), F.col("pos") + 1).alias(k)
    keep = [c for c in rows.columns if c not in names]
    return found.select("*", F.posexplode("id_").alias("pos", "one_")).select(*keep, "pos", *(at(k) for k in names))


def novelty_catalog(audits: DataFrame, manifests: DataFrame) -> DataFrame:
    """H9: audits and manifests (run_id, items array) aligned by position; statements fall back to the manifest's; UNKNOWN goes."""
    a = audits.select("run_id", F.posexplode_outer("items").alias("pos", "a"))
    m = manifests.select("run_id", F.posexplode_outer("items").alias("pos", "m"))
    out = a.join(m, ["run_id", "pos"], "left").select("run_id", "pos", T.class_code("a.classification").alias("class"), F.coalesce("a.statement", "m.statement").alias("statement"))
    return out.where("class <> 'UNKNOWN'")
