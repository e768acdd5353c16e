"""Entity normalisation and noise rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import ARTIFACT_PATTERNS, CANONICAL_NODES, NAME_PATTERN, NAME_WORDS, NODE_ALIASES, NODE_LEXICON, NOISE_WORDS, STOP_NODES
from . import text as T


def squeeze(c: Column | str) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(T.col(c), r"\s+", " "))


def normalize_entities(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label, type) against aliases (type, key, canonical), valid only for the expected type.

    Adds normalized, status (normalized or unresolved), method and canonical_key; one row per (normalized, type).
    """
    out = rows.withColumn("label", squeeze("label")).where("label <> ''").withColumn("canonical_key", T.canonical_key("label"))
    a = aliases.select(F.col("type"), F.col("key").alias("canonical_key"), "canonical")
    out = out.join(a, ["type", "canonical_key"], "left")
    out = out.withColumns({"normalized": F.coalesce("canonical", "label"), "status": F.when(F.col("canonical").isNull(), "unresolved").otherwise("normalized"), "method": F.when(F.col("canonical").isNull(), "none").otherwise("alias")})
    return out.drop("canonical").dropDuplicates(["normalized", "type"])


def titled(c: Column) -> Column:
    """Lower-case text with the first letter after anything but a letter in upper case."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.when(F.substring(w, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(w, 1, 1))), w.substr(F.lit(2), F.length(w)))), "")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` asks for it: a column of its own would be copied into each use."""
    return F.transform(F.array(value), then)[0]


def node_names(aliases: list[tuple[str, str]] = NODE_ALIASES) -> Callable[[Column | str], Column]:
    """``normalize_node`` for many columns: the aliases become literals once."""
    spellings = F.create_map(*(F.lit(x) for p in aliases for x in p))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in aliases))

    def named(low: Column) -> Column:
        near = F.try_element_at(F.filter(pairs, lambda p: F.contains(low, p["a"]) | F.contains(p["a"], low)), F.lit(1))["n"]
        own = F.when((F.length(low) > 2) & (F.length(low) < 60), titled(low))
        return F.coalesce(F.try_element_at(spellings, low), near, own)

    return lambda c: once(F.lower(squeeze(c)), named)


def normalize_node(c: Column | str, aliases: list[tuple[str, str]] = NODE_ALIASES) -> Column:
    """Exact alias, then the first alias that contains the text or is contained in it, then the text if 3 to 59 characters long."""
    return node_names(aliases)(c)


def classify_node(c: Column | str, lexicon: dict[str, list[str]] = NODE_LEXICON) -> Column:
    """Type of a node by lexicon; muscles are tissue; else Unknown."""
    out = F.when(F.contains(F.lower(T.col(c)), F.lit("muscle")), "Tissue").otherwise("Unknown")
    for kind, names in reversed(lexicon.items()):
        out = F.when(T.col(c).isin(names), kind).otherwise(out)
    return out


def looks_like_noise(c: Column | str, noise: list[str] = NOISE_WORDS) -> Column:
    """No word or five and more, a noise word at an edge or anywhere among three and more, or a leading number."""
    words = F.split(squeeze(c), " ")
    low = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:"))))
    bad = lambda w: w.isin(list(noise))
    n = F.size(words)
    return (squeeze(c) == "") | (n >= 5) | bad(low[0]) | bad(F.element_at(low, -1)) | ((n >= 3) & F.exists(low, bad)) | words[0].rlike("^[0-9]+$")


def artifact_reason(c: Column | str, canonical: list[str] = CANONICAL_NODES, stop: list[str] = STOP_NODES, patterns: list[str] = ARTIFACT_PATTERNS, aliases: list[tuple[str, str]] = NODE_ALIASES) -> Column:
    """Why a label is an artifact, else null; canonical labels, aliases and names like IL-5 never are."""
    label = T.col(c)
    low = F.lower(F.trim(label))
    words = F.split(squeeze(label), " ")
    fine = label.isin([*canonical, *(name for _, name in aliases)])
    spared = low.isin([a for a, _ in aliases]) | label.rlike(r"(?i)^IL-?\d+[a-z]?$")
    out = F.when(fine, F.lit(None).cast("string")).when(label.isin(list(stop)), "stopword_node").when(spared, F.lit(None).cast("string")).when(F.size(words) > 6, "too_many_words")
    for p in patterns:
        out = out.when(label.rlike(f"(?i){p}"), f"pattern:{p[:40]}")
    capital = F.substring(words[0], 1, 1).rlike(r"^\p{Lu}")
    named = F.exists(words, lambda w: F.lower(w).isin(NAME_WORDS)) | low.rlike(NAME_PATTERN)
    return out.when((F.size(words) >= 3) & capital & ~named, "sentence_fragment")


def context_value(c: Column | str) -> Column:
    """Blank is unknown, any text is unresolved with the raw value kept."""
    value = F.trim(F.coalesce(T.col(c), F.lit("")))
    blank = value == ""
    text = lambda x: F.lit(x).cast("string")
    return F.struct(text(None).alias("value"), text(None).alias("identifier"), F.when(blank, "unknown").otherwise("unresolved").alias("status"), F.when(~blank, value).alias("raw"), F.when(blank, "not provided").otherwise("no verified mapping").alias("reason"))


#: Fields of a structured context, keys of a context value, and its statuses.
CONTEXT_FIELDS = ["tissue", "cell_type", "species", "anatomical_compartment", "model", "assay"]
CONTEXT_KEYS = ["value", "identifier", "status", "raw", "reason"]
STATUSES = ["known", "unknown", "unresolved"]


def checked_value(text: Column) -> Column:
    """One field of a context as it came: null, plain text (unresolved), or a JSON object of its own, whose state must hold together; ``error`` tells what doesn't."""
    return once(F.trim(F.coalesce(text, F.lit(""))), _checked_given)


def _checked_given(given: Column) -> Column:
    plain = context_value(given)
    own = F.from_json(given, "struct<" + ",".join(f"{k}:string" for k in CONTEXT_KEYS) + ">")
    none = F.lit(None).cast("string")

    def checked(j: Column) -> Column:
        part = {k: j[k] for k in CONTEXT_KEYS}
        status = F.coalesce(part["status"], F.lit("unknown"))
        resolved = part["value"].isNotNull() | part["identifier"].isNotNull()
        extra = F.array_sort(F.array_except(j["keys"], F.array(*map(F.lit, CONTEXT_KEYS))))
        error = (
            F.when(F.size(extra) > 0, F.concat(F.lit("extra fields: "), F.array_join(extra, ", ")))
            .when(~status.isin(STATUSES), F.concat(F.lit("unknown status: "), status))
            .when((status == "known") & ~resolved, "known context values require value or identifier")
            .when((status == "unknown") & resolved, "unknown context values cannot contain a resolved value")
            .when((status == "unresolved") & part["raw"].isNull() & part["value"].isNull(), "unresolved context values require raw input or value")
        )
        as_object = F.struct(part["value"].alias("value"), part["identifier"].alias("identifier"), status.alias("status"), part["raw"].alias("raw"), part["reason"].alias("reason"), error.alias("error"))
        as_text = F.struct(*(plain[k].alias(k) for k in CONTEXT_KEYS), none.alias("error"))
        as_other = F.struct(none.alias("value"), none.alias("identifier"), F.lit("unknown").alias("status"), given.alias("raw"), none.alias("reason"), F.lit("must be a string, object, or null").alias("error"))
        return F.when(j["keys"].isNotNull(), as_object).when(given.startswith("["), as_other).otherwise(as_text)

    parts = once(own, lambda o: F.struct(F.json_object_keys(given).alias("keys"), *(F.nullif(F.trim(o[k]), F.lit("")).alias(k) for k in CONTEXT_KEYS)))
    return once(parts, checked)


def structured_context(c: Column | str) -> Column:
    """A context given as a JSON object: a checked value of each field, the fields supplied, and all errors (unknown fields, then those of the
    fields in order). Text that is no object has that as its only error. The text is parsed once."""
    text = T.col(c)
    bad = F.json_object_keys(text).isNull() & (F.trim(F.coalesce(text, F.lit(""))) != "")

    def checked(fields: Column) -> Column:
        unknown = F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, CONTEXT_FIELDS))))
        first = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown context fields: "), F.array_join(unknown, ", ")))
        values = F.struct(*(checked_value(F.try_element_at(fields, F.lit(f))).alias(f) for f in CONTEXT_FIELDS), first.alias("first_"))
        return once(values, told)

    def told(v: Column) -> Column:
        errors = F.array_compact(F.array(v["first_"], *(F.concat(F.lit(f"{f}: "), v[f]["error"]) for f in CONTEXT_FIELDS)))
        supplied = F.array_compact(F.array(*(F.when(v[f]["status"] != "unknown", f) for f in CONTEXT_FIELDS)))
        return F.struct(*(v[f].alias(f) for f in CONTEXT_FIELDS), supplied.alias("supplied"), F.when(bad, F.array(F.lit("no object"))).otherwise(errors).alias("errors"))

    return once(F.from_json(text, "map<string,string>"), checked)


DRUG_SCHEMA = "struct<name:string,drug_name:string,identifiers:array<struct<namespace:string,value:string>>,claims:array<struct<predicate:string,object:string,provenance:string>>>"


def normalize_drug(c: Column | str) -> Column:
    """A drug payload (JSON): name, identifiers with namespace and value, status, claims with all their parts."""
    p = F.from_json(T.col(c), DRUG_SCHEMA)
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    ids = F.filter(F.coalesce(p["identifiers"], F.array()), lambda i: has(i["namespace"]) & has(i["value"]))
    claims = F.filter(F.coalesce(p["claims"], F.array()), lambda k: has(k["predicate"]) & has(k["object"]) & has(k["provenance"]))
    name = F.coalesce(F.nullif(F.trim(p["name"]), F.lit("")), F.nullif(F.trim(p["drug_name"]), F.lit("")))
    return F.struct(name.alias("name"), F.when(name.isNull(), "unknown").when(F.size(ids) > 0, "known").otherwise("unresolved").alias("status"), ids.alias("identifiers"), claims.alias("claims"))
