"""String, hash and array expressions (N1-N5, N12-N16); all native columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"(?<=[.!?])\s+"
DASHES = "‐‑‒–—―−"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact_label(c: Column | str) -> Column:
    """Lower case, nothing but a-z and 0-9; null gives an empty key."""
    return F.regexp_replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def canonical_key(c: Column | str) -> Column:
    """Key of a label with dashes folded, ASCII path; ``canonical_key_nfkc`` handles compatibility forms."""
    return compact_label(F.translate(col(c), DASHES, "-" * len(DASHES)))


def canonical_key_nfkc(c: Column | str) -> Column:
    """``canonical_key`` after NFKC and full case folding, which have no built-in expression (Arrow UDF, opt-in)."""

    def keys(labels: pd.Series) -> pd.Series:
        folded = labels.fillna("").str.normalize("NFKC").str.casefold()
        return folded.str.replace(r"[^a-z0-9]+", "", regex=True)

    return F.pandas_udf(keys, "string")(col(c))


def slugify(c: Column | str, default: str = "target") -> Column:
    """Runs of other characters become one underscore; empty slugs get the default."""
    slug = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^_+|_+$", ""), F.lit("")), F.lit(default))


def split_sentences(c: Column | str) -> Column:
    """Array of sentences, split after . ! or ? before white space."""
    return F.split(F.trim(col(c)), SENTENCE_END)


def entity_mentioned(label: Column | str, text: Column | str) -> Column:
    """Whether the label's compact key occurs in the compact text; false for an empty key."""
    key = compact_label(label)
    return (F.length(key) > 0) & F.contains(compact_label(text), key)


def supporting_sentence(text: Column | str, *terms: Column) -> Column:
    """First sentence that mentions all terms, else null."""

    def has_all(s: Column) -> Column:
        found = F.lit(True)
        for t in terms:
            found = found & entity_mentioned(t, s)
        return found

    return F.try_element_at(F.filter(split_sentences(text), has_all), F.lit(1))


def claim_id(*parts: Column, prefix: str = "claim_") -> Column:
    """Prefix and 16 hex digits of the SHA-256 of the parts joined by bars; null parts are empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))


def evidence_strength(n: Column | str) -> Column:
    return F.when(col(n) >= 3, "strong").when(col(n) >= 2, "moderate").otherwise("weak")


def extract_sample_size(c: Column | str, mode: str = "equals") -> Column:
    """``equals``: n = 12; ``loose``: a word n or N, then 2 to 6 digits. Letters and digits of any script make words.

    The character before the word is consumed: a look behind sees half of one beyond the first 65,536.
    """
    pattern = r"n\s*=\s*(\d+)" if mode == "equals" else r"(?:^|[^\p{L}\p{N}_])[nN]\s*[=,:]?\s*(\d{2,6})(?![\p{L}\p{N}_])"
    found = F.regexp_extract(F.lower(col(c)) if mode == "equals" else col(c), pattern, 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def stable_unique(c: Column | str) -> Column:
    """Distinct elements, first occurrences in order."""
    return F.array_distinct(col(c))


def class_code(c: Column | str) -> Column:
    """RESTATED, a lone letter A to E, or UNKNOWN."""
    text = F.upper(F.coalesce(col(c), F.lit("")))
    letter = F.regexp_extract(text, r"\b([A-E])\b", 1)
    return F.when(F.contains(text, F.lit("RESTATED")), "RESTATED").when(letter != "", letter).otherwise("UNKNOWN")


def truncate(c: Column | str, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n - 1), F.lit("…"))).otherwise(col(c))


def sorted_join(c: Column | str) -> Column:
    """Array as one string of its sorted elements, for reports and comparisons."""
    return F.array_join(F.array_sort(col(c)), ",")


def padded(n: Column | str, width: int = 3) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    text = col(n).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
