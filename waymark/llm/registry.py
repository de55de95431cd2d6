"""Queries and SQL of the operators, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html, jaccard, langid, licenses, negatives, packing, secrets, sharding, topk, toxicity, urlfilter
from .common import table

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = r"regexp_extract_all(" + LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.word_list(public_tokenizers.path("word_bpe_49k.json"))
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.seed_findings(spark), words=words), path="source", words=words)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.url_verdicts(pages.select("page_id", "url"), urlfilter.link_edges(pages), urlfilter.rule_table(spark))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0)).drop("evaluated")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_vectors(table(spark, sf_dir, "embeddings"), 256, label)
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
with recursive dw as (select doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as i from dw where len(w) > 0)),
size as (select doc_id, count(*) as n from sh group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b using (s) where a.doc_id <> b.doc_id group by all),
links as (select a, b from inter join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) as component_id
from documents d left join size using (doc_id) left join reach on reach.a = d.doc_id group by d.doc_id
"""

# the links of the pages as their markup states them with absolute targets; blocks go along them as far as they reach
OP5_SQL = r"""
with recursive tags as (
  select url as src, unnest(regexp_extract_all(html, '<(?:link|meta)\s[^>]*>', 0, 'i')) as tag from pages where url is not null),
targets as (
  select src, regexp_extract(tag, 'href\s*=\s*["'']([^"'']*)["'']', 1, 'i') as dst from tags where regexp_matches(tag, '^<link', 'i') and regexp_matches(tag, 'rel\s*=\s*["'']?canonical', 'i')
  union all
  select src, regexp_extract(tag, 'url\s*=\s*([^"''>]*)', 1, 'i') from tags where regexp_matches(tag, '^<meta', 'i') and regexp_matches(tag, 'http-equiv\s*=\s*["'']?refresh', 'i')),
links as (select distinct src, dst from targets where contains(dst, '://') and src <> dst),
both_ways as (select src as a, dst as b from links union select dst, src from links),
urls as (select url from pages union select a from both_ways),
parts as (
  select url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from urls),
rules(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select url, rh || rp as rule, rv, row_number() over (partition by url order by length(rh) + length(rp) desc, rh desc, rp desc) as k
  from parts, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
spread(url) as (select url from fits where k = 1 and rv = 'block' union select b from spread join both_ways on a = url)
select p.page_id, coalesce(u.host, '') as host, coalesce(u.path, '') as path, f.rule, coalesce(f.rv, case when s.url is not null then 'block' else 'allow' end) as verdict
from pages p left join parts u on u.url = p.url left join fits f on p.url = f.url and f.k = 1 left join spread s on s.url = p.url
"""

OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_prepend(0, list_transform(range(1, len(q.v) + 1), lambda i: coalesce(q.v[i] * c.v[i], 0))))::bigint as score
  from v q, v c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""

OP10_SQL = f"""
with iw as (select item_id, {WORDS_SQL} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(13, len(w)) as size, list_slice(w, i, i + least(13, len(w)) - 1) as words
  from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from iw where len(w) > 0)),
dw as (select doc_id, {WORDS_SQL} as w from documents),
dwin as (
  select doc_id, size, i, list_slice(w, i, i + size - 1) as words
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, (select distinct size from win) where len(w) >= size)),
hits as (select doc_id, item_id, i, d.size from dwin d join win using (size, words)),
n_hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join n_hit using (doc_id) left join items using (doc_id)
"""

OP11_SQL = """
with e as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as anchor_id, c.id, a.label = c.label as same, list_sum(list_prepend(0, list_transform(range(1, len(a.v) + 1), lambda i: coalesce(a.v[i] * c.v[i], 0))))::bigint as score
  from e a, e c where a.id % 100 = 0 and a.id <> c.id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as k from s where same) where k <= 5),
n as (
  select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

TERMS_SQL = r"regexp_extract_all(" + LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r, {TERMS_SQL} as w from documents),
g as (select distinct lang, source from d),
t as (select lang, source, r, unnest(w) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*)::hugeint as v from kept group by lang),
c as (select lang, source, term, count(*)::hugeint as n from t join kept using (lang, term) group by all),
each as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n from g join kept k using (lang) left join c using (lang, source, term)),
total as (select lang, source, sum(n)::hugeint as total from each group by lang, source),
share as (select lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * v) as p from each join total using (lang, source) join v using (lang)),
whole as (select lang, term, 1 + (1000000000 * (sum(n)::hugeint + 2)) // (sum(sum(n)) over (partition by lang)::hugeint + 2 * any_value(v)) as q from c join v using (lang) group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from share a join share b using (lang, term) where a.source <> b.source group by all),
ranked as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b using (lang) left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source where a.source <> b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from share join whole using (lang, term) where n > 0 and p > q),
numbered as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from ranked)
select lang, source, part, item, value, rank::int as rank from numbered where part = 'pair' or rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_html_extraction": op3_html_extraction,
        "op4_toxicity": op4_toxicity,
        "op5_url_filter": op5_url_filter,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_language_id": op7_language_id,
        "op8_license_scan": op8_license_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_decontamination": op10_decontamination,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_source_divergence": op12_source_divergence,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op5_url_filter": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_source_divergence": OP12_SQL}
