"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, embed, language, linedup, lm, media, mixing, near, phrases, sharding, tokens, toxicity

QUERIES = {
    "op1_line_dedup": linedup.op1_line_dedup,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_sharding": sharding.op5_sharding,
    "op6_ngram_jaccard": near.op6_ngram_jaccard,
    "op7_embeddings": embed.op7_embeddings,
    "op8_tiff": media.op8_tiff,
    "op9_language": language.op9_language,
    "op10_sentencepiece": tokens.op10_sentencepiece,
    "op11_collocations": phrases.op11_collocations,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_centroids": centroids.op13_centroids,
}

#: Shingle sets from the words themselves, all pairs that share a shingle, and what links reach.
JACCARD_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
  s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) shingle from w),
  n as (select doc_id, count(*) n from s group by doc_id),
  shared as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2),
  links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
  both_ways as (select a, b from links union all select b, a from links),
  reach as (select doc_id, doc_id least_id from documents union select b, least_id from reach join both_ways on a = reach.doc_id),
  c as (select doc_id, min(least_id) component_id from reach group by doc_id)
  select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id"""



#: All phrases of up to five words of all pieces, counted; cuts by joins of the counts, in 128-bit numbers.
COLLOCATION_SQL = r"""with w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from (select coalesce(lang, 'und') lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents)),
  g as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase from w, (select unnest([1, 2, 3, 4, 5]) m)),
  f as materialized (select lang, m, phrase, count(*) f from g group by lang, m, phrase having count(*) >= 100), t as (select lang, sum(len(w)) n from w group by lang),
  c as (select *, string_split(phrase, ' ') w from f where m > 1),
  longer as (select lang, array_to_string(w[i:j], ' ') phrase, max(f) f from (select *, unnest(range(1, m + 1)) i from c), unnest(range(1, 6)) u(j) where j > i and j <= m and j - i + 1 < m group by 1, 2),
  kept as (select c.* from c left join longer using (lang, phrase) where longer.f is null or 100 * longer.f < 100 * c.f),
  cuts as (select kept.lang, kept.phrase, kept.f a, k, l.f l, r.f r, cast(t.n as bigint) n, cast((1000::hugeint * kept.f * t.n) // (l.f::hugeint * r.f) as bigint) score
  from (select *, unnest(range(1, m)) k from kept) kept join f l on l.lang = kept.lang and l.phrase = array_to_string(kept.w[1:k], ' ') join f r on r.lang = kept.lang and r.phrase = array_to_string(kept.w[k + 1:kept.m], ' ') join t on t.lang = kept.lang),
  best as (select *, row_number() over (partition by lang, phrase order by score, k) cut from cuts),
  ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from best where cut = 1)
  select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000"""


def _centroid_sql(rounds: int = centroids.ROUNDS, k: int = centroids.K) -> str:
    """Rounds of nearest centroids (least of distance * k + number) and exact floors of the means, one after the other."""
    parts = [
        """with e as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 k, v c from (select sha256('3:' || vec_id) h, v from e order by h, v limit {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select rid, min({k} * list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) + k) m from e cross join c{r} group by rid)")
        if r < rounds:
            parts.append(
                f"""s{r} as (select m % {k} k, p, sum(x) s, count(*) n from (select m, unnest(v) x, unnest(range(64)) p from e join a{r} using (rid)) group by all),
  c{r + 1} as materialized (select k, coalesce(f, c) c from c{r} left join (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by p) f from s{r} group by k) using (k))"""
            )
    last = f"o as (select vec_id, m % {k} k, m // {k} d from e join a{rounds} using (rid)), t as (select k, sum(d) ci from o group by k)"
    return ", ".join([*parts, last]) + f""" select vec_id, cast(k as integer) cluster, cast(d as bigint) distance, cast(ci as bigint) cluster_inertia, cast((select sum(d) from o) as bigint) inertia,
  sha256(array_to_string(c, ',')) centroid_sha256 from o join t using (k) join c{rounds} using (k)"""


ORACLE: dict[str, str] = {"op6_ngram_jaccard": JACCARD_SQL, "op11_collocations": COLLOCATION_SQL, "op13_centroids": _centroid_sql()}
