"""Claim extraction (X1-X7): one scan of the corpus, patterns as literals, sentences split once per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.normalize import classify_node, node_names, once
from ..vocab import CAUSAL_CUES, CAUSAL_VERBS, DIRECT_CUES, GENE_ALIASES, INDIRECT_CUES, NODE_ALIASES, NODE_LEXICON, PATHWAYS, POSITIVE_CUES, SUPPRESS_CUES, TEMPLATES

PAPER = ["pmid", "year", "species"]
#: So many names, asked for in one call, are looked for one by one.
FEW_NAMES = 64
#: A letter or digit of any script, and white space of any kind: what ends of a causal claim are made of.
LETTER, BLANK = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x{85}\p{Z}"


def extract_templates(pubs: DataFrame, templates: list[tuple[str, str, str, str]] = TEMPLATES, confidence: str = "confidence", lexicon: dict[str, list[str]] = NODE_LEXICON) -> DataFrame:
    """(source, relation, target, regex) found anywhere in the lower-cased abstract, with its supporting sentence."""
    low = F.lower("abstract")
    hits = [F.when(low.rlike(p), F.struct(F.lit(s).alias("source"), F.lit(r).alias("relation"), F.lit(t).alias("target"))) for s, r, t, p in templates]
    rows = pubs.where("coalesce(abstract, '') <> ''").withColumn("h", F.explode(F.array_compact(F.array(*hits))))
    rows = rows.select(*PAPER, F.col(confidence).alias("confidence"), "abstract", "h.*")
    sentence = T.supporting_sentence("abstract", F.col("source"), F.col("target"))
    kinds = [classify_node(e, lexicon).alias(f"{e}_type") for e in ("source", "target")]
    return rows.select(*PAPER, "confidence", "source", "relation", "target", *kinds, F.lit("template").alias("extraction_method"), sentence.alias("source_sentence"))


def extract_templates_by_token(pubs: DataFrame, templates: DataFrame) -> DataFrame:
    """X1 for large vocabularies: templates (source, relation, target, token, pattern) meet documents on a literal word they need."""
    tokens = pubs.select("pmid", F.explode(F.array_distinct(F.split(F.lower("abstract"), r"[^a-z0-9]+"))).alias("token"))
    candidates = tokens.join(templates, "token").drop("token").distinct()
    full = candidates.join(pubs.select(*PAPER, "abstract"), "pmid")
    return full.where("lower(abstract) rlike pattern").select(*PAPER, "source", "relation", "target")


def extract_patterns(pubs: DataFrame, seen: DataFrame, aliases: list[tuple[str, str]] = NODE_ALIASES, verbs=CAUSAL_VERBS, confidence: str = "confidence", lexicon: dict[str, list[str]] = NODE_LEXICON) -> DataFrame:
    """Causal verbs; both ends normalised, self-loops and short ends dropped, once per paper, not where X1 (``seen``) has it.

    A paper's matches become distinct inside its row, so abstracts aren't shuffled. A text is cut into runs once; a run is read for
    single verbs only where it has some verb.
    """
    # a match lies in one run of the characters that its ends may have
    runs = F.split(F.lower("abstract"), rf"[^{LETTER}{BLANK}\-+/]+")
    name = node_names(aliases)
    found = once(runs, lambda r: _claims_in(r, list(verbs), name))
    good = lambda m: (m["source"] != m["target"]) & (F.length(m["source"]) > 2) & (F.length(m["target"]) > 2)
    rows = pubs.where("coalesce(abstract, '') <> ''").select(*PAPER, F.greatest(F.col(confidence) - 0.15, F.lit(0.3)).alias("confidence"), "abstract", F.explode(F.array_distinct(F.filter(found, good))).alias("m"))
    rows = rows.select(*PAPER, "confidence", "m.source", "m.relation", "m.target", T.supporting_sentence("abstract", F.col("m.source"), F.col("m.target")).alias("source_sentence"))
    rows = rows.withColumns({f"{e}_type": classify_node(e, lexicon) for e in ("source", "target")}).withColumn("extraction_method", F.lit("pattern"))
    rows = rows.dropDuplicates(["pmid", "source", "relation", "target"])
    return rows.join(seen.select("pmid", "source", "relation", "target").distinct(), ["pmid", "source", "relation", "target"], "left_anti")


def _claims_in(runs: Column, verbs: list[tuple[str, str]], name) -> Column:
    """The claims of all runs, in order of the verbs. Runs are looked through for all verbs at once; those that have one, for either half of the verbs, and so on."""
    if not verbs:
        return F.array().cast("array<struct<source:string,relation:string,target:string>>")

    def found(hits: Column) -> Column:
        if len(verbs) == 1:
            forms, relation = verbs[0]
            return F.transform(_ends_in(hits, forms), _ends_of(relation, name))
        half = len(verbs) // 2
        return F.concat(_claims_in(hits, verbs[:half], name), _claims_in(hits, verbs[half:], name))

    return once(F.filter(runs, _matching_verb("|".join(forms for forms, _ in verbs))), found)


def _ends_in(runs: Column, forms: str) -> Column:
    """[source, target] of each run with the verb between them. A run has one match at most: all its characters may stand in an end, so the source begins with
    the run's first letter (what no later verb follows there, none follows further on) and the target takes the rest. So the pattern is tied to the
    run's beginning, and runs without a match aren't tried again from each of their letters."""
    ends = rf"(?s)^[^{LETTER}]*+([{LETTER}].+?)[{BLANK}]+(?:{forms})[{BLANK}]+([{LETTER}].+)"
    # \x01 stands in no run
    cut = F.transform(runs, lambda run: F.split(F.regexp_replace(run, ends, "$1\x01$2"), "\x01"))
    return F.filter(cut, lambda e: F.size(e) == 2)


def _matching_verb(forms: str):
    return lambda run: run.rlike(rf"[{BLANK}](?:{forms})[{BLANK}]")


def _ends_of(relation: str, name):
    """A match as a claim; a function of one argument, since higher-order functions pass an index to a second."""
    return lambda m: F.struct(name(m[0]).alias("source"), F.lit(relation).alias("relation"), name(m[1]).alias("target"))


def _matching(pattern: str):
    return lambda s: s.rlike(f"(?i){pattern}")


def _asked(pubs: DataFrame, targets: DataFrame, *names: str, aliases: dict[str, list[str]] = {}, size: int = 3) -> DataFrame:
    """Papers with every request (run_id and one value of each of ``names``) whose first value, or an alias, they mention in compact form.

    An inverted join: each value is anchored on that of its runs of ``size`` characters which the fewest papers have; papers meet values on these
    anchors, and what meets is verified in the text. Up to ``FEW_NAMES`` names need no anchors: each is looked for in every text, which isn't shuffled then. Runs are of a-z and 0-9, so there are at most 36^size of them, whatever is asked for: papers are
    looked through for them in place, and only what they have of them travels. No request comes to the driver. A value of fewer characters is anchored on
    itself; one without any meets nothing.
    """
    t = targets
    for n in names:
        t = t.select("*", F.explode(n).alias(n[:-1])).drop(n)
    values = [n[:-1] for n in names]
    wanted = t.select("run_id", *values).distinct()
    first = F.col(values[0])
    own = F.array(first)
    for name, others in aliases.items():
        own = F.when(F.lower(first) == name, F.concat(F.array(first), F.array(*map(F.lit, others)))).otherwise(own)
    said = wanted.select(first.alias("value_"), F.explode(own).alias("said_")).select("value_", T.compact_label("said_").alias("key_")).where("key_ <> ''").distinct()
    texts = pubs.where("coalesce(abstract, '') <> '' and coalesce(pmid, '') <> ''").withColumns({"paper_": F.xxhash64("pmid", "abstract"), "compact_": T.compact_label("abstract")})
    keep = [c for c in pubs.columns if c not in ("run_id", *values)]
    if said.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        keys = said.groupBy("value_").agg(F.collect_list("key_").alias("keys_"))
        found = texts.crossJoin(F.broadcast(keys)).where(F.exists("keys_", lambda k: F.contains("compact_", k)))
        return found.join(F.broadcast(wanted), F.col("value_").eqNullSafe(first)).select(*keep, "run_id", *values)
    runs = lambda c, n: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
    parts = said.select("value_", "key_", F.explode(F.when(F.length("key_") >= size, runs(F.col("key_"), size)).otherwise(F.array("key_"))).alias("run_"))
    cut = texts.select("paper_", F.explode(F.concat(*(runs(F.col("compact_"), n) for n in range(1, size + 1)))).alias("run_"))
    often = cut.join(F.broadcast(parts.select("run_").distinct()), "run_", "left_semi").groupBy("run_").agg(F.count("*").alias("n_"))
    anchors = parts.join(often, "run_", "left").groupBy("value_", "key_").agg(F.min(F.struct(F.coalesce("n_", F.lit(0)).alias("n_"), "run_")).alias("x_")).select("value_", "key_", F.col("x_.run_").alias("run_"))
    met = cut.join(F.broadcast(anchors.select("run_").distinct()), "run_", "left_semi").join(anchors, "run_").select("paper_", "value_", "key_")
    found = met.join(texts.select("paper_", "compact_"), "paper_").where(F.contains("compact_", F.col("key_"))).select("paper_", "value_").distinct()
    rows = found.join(wanted, F.col("value_").eqNullSafe(first)).drop("value_")
    return texts.select("paper_", *keep).join(rows, "paper_").select(*keep, "run_id", *values)


def extract_drug_claims(pubs: DataFrame, targets: DataFrame, direct_cues: str = DIRECT_CUES, indirect_cues: str = INDIRECT_CUES) -> DataFrame:
    """A requested drug and gene in one sentence: direct cue binds_target, else indirect cue indirectly_modulates."""
    rows = _asked(pubs, targets, "drugs", "genes").where(F.contains(F.lower("abstract"), F.lower("drug")))
    # a row for each sentence found, rather than a condition on it: it is looked for once
    rows = rows.select("*", F.explode(F.array_compact(F.array(T.supporting_sentence("abstract", F.col("drug"), F.col("gene"))))).alias("source_sentence"))
    low = F.lower("source_sentence")
    predicate = F.when(low.rlike(direct_cues), "binds_target").when(low.rlike(indirect_cues), "indirectly_modulates")
    rows = rows.withColumn("predicate", predicate).where("predicate is not null")
    direct = F.col("predicate") == "binds_target"
    obj = F.when(direct, F.concat("gene", F.lit(" protein"))).otherwise(F.col("gene"))
    rows = rows.withColumns({"object": obj, "target": F.col("gene"), "target_type": F.when(direct, "Molecule").otherwise("Gene"), "confidence": F.when(direct, 0.75).otherwise(0.55)})
    rows = rows.withColumn("claim_id", T.claim_id(*(F.col(c) for c in ("drug", "predicate", "object", "pmid")), prefix="drugclaim_"))
    return rows.select("run_id", *PAPER, "drug", "predicate", "object", "target", "target_type", "confidence", "source_sentence", "claim_id").dropDuplicates(["run_id", "drug", "predicate", "object", "pmid"])


def extract_drug_pathways(pubs: DataFrame, targets: DataFrame, pathways: dict[str, str] = PATHWAYS) -> DataFrame:
    """A requested drug and a pathway name in one sentence: an indirect claim."""
    rows = _asked(pubs, targets, "drugs").withColumn("sentences", F.filter(T.split_sentences("abstract"), lambda s: T.entity_mentioned(F.col("drug"), s)))
    hits = [F.struct(F.lit(n).alias("target"), F.try_element_at(F.filter("sentences", _matching(p)), F.lit(1)).alias("source_sentence")) for n, p in pathways.items()]
    rows = rows.where("size(sentences) > 0").select("run_id", *PAPER, "drug", F.inline(F.array(*hits))).where("source_sentence is not null")
    return rows.select("run_id", *PAPER, "drug", F.lit("indirectly_modulates").alias("predicate"), F.concat("target", F.lit(" pathway")).alias("object"), "target", F.lit("Pathway").alias("target_type"), F.lit(0.6).alias("confidence"), "source_sentence", T.claim_id(F.col("drug"), F.lit("indirectly_modulates"), F.col("target"), F.col("pmid"), prefix="drugclaim_").alias("claim_id"))


def extract_gene_pathways(pubs: DataFrame, targets: DataFrame, pathways: dict[str, str] = PATHWAYS, cues: str = CAUSAL_CUES, aliases: dict[str, list[str]] = GENE_ALIASES) -> DataFrame:
    """Gene and pathway in one sentence with a causal cue between them; sentences on the gene's inhibitors don't count.

    A gene is found by its name, else by the first of its aliases (by lower-case name) that the sentence has.
    """
    rows = _asked(pubs, targets, "genes", aliases=aliases).select("run_id", *PAPER, "gene", F.explode(T.split_sentences("abstract")).alias("sentence"))
    more = F.lit(None).cast("array<string>")
    for gene, names in aliases.items():
        more = F.when(F.lower("gene") == gene, F.array(*map(F.lit, names))).otherwise(more)
    names = F.concat(F.array("gene"), F.coalesce(more, F.array().cast("array<string>")))
    found = F.array_compact(F.transform(names, lambda n: F.regexp_substr("sentence", F.concat(F.lit(r"(?i)\b\Q"), n, F.lit(r"\E\b")))))
    rows = rows.withColumn("gene_named", F.try_element_at(found, F.lit(1))).where("gene_named is not null")
    hits = [F.when(F.col("sentence").rlike(f"(?i){p}"), F.struct(F.lit(n).alias("target"), F.regexp_substr("sentence", F.lit(f"(?i){p}")).alias("named"))) for n, p in pathways.items()]
    rows = rows.select("*", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("run_id", *PAPER, "gene", "gene_named", "sentence", "h.*")
    rows = rows.where(~F.rlike("sentence", F.concat(F.lit(r"(?i)\b\Q"), "gene", F.lit(r"\E\s+(inhibitor|inhibitors|inhibition|is)"))))
    named = F.col("gene_named")
    g, p = F.instr(F.col("sentence"), named), F.instr(F.col("sentence"), F.col("named"))
    low = F.least(g, p)
    high = F.greatest(g + F.length(named), p + F.length("named"))
    rows = rows.withColumn("between", F.substr(F.col("sentence"), low, high - low)).where(F.col("between").rlike(f"(?i){cues}"))
    cue = F.regexp_instr("between", F.lit(f"(?i){cues}"))
    rows = rows.where(~F.substr(F.col("between"), F.lit(1), cue - 1).rlike(r"(?i)\binhibitor\w*\b"))
    negative = F.col("between").rlike(f"(?i){SUPPRESS_CUES}") & ~F.col("between").rlike(f"(?i){POSITIVE_CUES}")
    out = rows.select("run_id", *PAPER, F.col("gene").alias("source"), F.when(negative, "suppresses").otherwise("activates").alias("relation"), "target", F.trim("sentence").alias("source_sentence"), F.lit(0.6).alias("confidence"))
    return out.dropDuplicates(["run_id", "source", "target", "relation", "pmid", "source_sentence"])


def attach_context(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Session and context of the run's target on every claim."""
    context = F.struct("cell_types", F.array_compact(F.array("disease")).alias("disease"), "drugs", "tissues")
    t = targets.select("run_id", context.alias("context"))
    return claims.drop("context").join(t, "run_id", "left").withColumns({"session": F.col("run_id"), "provenance_status": F.when(F.coalesce("pmid", F.lit("")) != "", "pmid_backed").otherwise("unsupported")})


def extraction_stats(pubs: DataFrame, claims: DataFrame) -> DataFrame:
    """Papers, papers with a claim, rate, raw claims and claims by method, in one row."""
    c = claims.agg(F.count_distinct("pmid").alias("papers_with_claim"), F.count("*").alias("raw_claims"), F.count_if(F.col("extraction_method") == "template").alias("template_claims"), F.count_if(F.col("extraction_method") == "pattern").alias("pattern_claims"))
    return pubs.agg(F.count_distinct("pmid").alias("papers")).crossJoin(c).withColumn("rate", F.round(F.col("papers_with_claim") / F.greatest("papers", F.lit(1)), 4))
