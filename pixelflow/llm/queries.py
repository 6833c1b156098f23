"""Registered queries of the corpus operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, linededup, lm, ngramjoin, pii, tokenio, topk, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, query="vec_id % 50 = 0", scale=256)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenio.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op4_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.groups(_table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(_table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_toxicity, op3_token_files, op4_ngram_groups, op5_url_rules, op6_personal_data, op7_lm_scores, op8_line_chunks, op9_decontamination, op10_byte_bpe)}

ORACLES: dict[str, str] = {}

ORACLES["op9_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""

ORACLES["op1_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def _sql_part(url: str, k: int) -> str:
    tail = (r"([^/?#]*)", r"[^/?#]*([^?#]*)", r"[^/?#]*[^?#]*(\?[^#]*)")[k]
    found = f"coalesce(regexp_extract({url}, '^.*?://{tail}', 1, 's'), '')"
    return f"translate({found}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if k == 0 else found


def _sql_plain(path: str) -> str:
    """A path without dot segments."""
    step = "lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END"
    rebuilt = rf"list_reduce(list_prepend('', string_split({path}, '/')[2:]), {step}) || CASE WHEN regexp_matches({path}, '/\.\.?$') THEN '/' ELSE '' END"
    return rf"CASE WHEN regexp_matches({path}, '/\.\.?(/|$)') THEN {rebuilt} WHEN {path} = '' THEN '/' ELSE {path} END"


def _sql_resolved(target: str, host: str, path: str) -> str:
    folder = f"regexp_replace({path}, '[^/]*$', '')"
    return f"""CASE WHEN {target} = '' THEN NULL WHEN contains({target}, '://') THEN {target} WHEN starts_with({target}, '//') THEN 'x:' || {target} WHEN starts_with({target}, '/') THEN 'x://' || {host} || {target}
WHEN starts_with({target}, '?') THEN 'x://' || {host} || {path} || {target} WHEN regexp_matches({target}, '^#|^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE 'x://' || {host} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {target} END"""


def _sql_attribute(tag: str, name: str) -> str:
    found = rf"""regexp_extract({tag}, '(?i)[\s/"'']{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]*)', 1)"""
    return rf"""trim({found}, E' \t\n\r\f"\'')"""


_AMPERSANDS = "'(?i)&(?:amp|#38|#x26);', '&', 'g'"

ORACLES["op5_url_rules"] = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, html, {_sql_part('url', 0)} AS host, {_sql_part('url', 1)} AS path, {_sql_part('url', 2)} AS query FROM pages),
p AS (SELECT *, CASE WHEN host <> '' THEN host || {_sql_plain('path')} || query END AS node FROM u),
lists AS (SELECT host, path, node, regexp_extract_all(html, '(?i)<(?:link|meta|base)[\s/"''][^<>]*') AS tags FROM p WHERE node IS NOT NULL),
bases AS (SELECT *, list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base')), lambda t: {_sql_attribute('t', 'href')}), lambda h: h <> '')[1] AS base FROM lists),
based AS (SELECT host, path, node, tags, regexp_replace(base, {_AMPERSANDS}) AS base FROM bases),
against AS (SELECT node, tags, coalesce({_sql_resolved('base', 'host', 'path')}, 'x://' || host || path) AS against FROM based),
named AS (SELECT node, {_sql_part('against', 0)} AS host, {_sql_part('against', 1)} AS path, unnest(tags) AS tag FROM against),
raw AS (SELECT node, host, path, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({_sql_attribute('tag', 'rel')}), '(^|\s)canonical(\s|$)') THEN {_sql_attribute('tag', 'href')}
WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_sql_attribute('tag', 'http-equiv')}) = 'refresh' THEN regexp_extract({_sql_attribute('tag', 'content')}, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS t FROM named),
hrefs AS (SELECT node, host, path, regexp_replace(t, {_AMPERSANDS}) AS t FROM raw WHERE t <> ''),
full_urls AS (SELECT node, {_sql_resolved('t', 'host', 'path')} AS t FROM hrefs),
split AS (SELECT node, {_sql_part('t', 0)} AS h, {_sql_part('t', 1)} AS q, {_sql_part('t', 2)} AS k FROM full_urls WHERE t IS NOT NULL),
e AS (SELECT DISTINCT node AS a, h || {_sql_plain('q')} || k AS b FROM split WHERE h <> ''),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT DISTINCT a AS n, a AS r FROM sym UNION SELECT sym.b, reach.r FROM reach JOIN sym ON reach.n = sym.a),
cls AS (SELECT n, min(r) AS c FROM reach GROUP BY n),
rules(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
mem AS (SELECT c, n, regexp_extract(n, '^([^/]*)', 1) AS host, regexp_extract(n, '^[^/]*([^?]*)', 1) AS path FROM cls),
memv AS (SELECT c, n, arg_max(v, length(rules.h || rules.q)) AS v FROM mem JOIN rules ON (mem.host = rules.h OR ends_with(mem.host, '.' || rules.h)) AND starts_with(mem.path, rules.q) GROUP BY c, n),
cv AS (SELECT c, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS blocked FROM memv GROUP BY c),
pages_rid AS (SELECT *, row_number() OVER () AS rid FROM p),
own AS (SELECT rid, arg_max(rules.h || rules.q, length(rules.h || rules.q)) AS rule, arg_max(v, length(rules.h || rules.q)) AS v FROM pages_rid JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.q) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM pages_rid LEFT JOIN own USING (rid) LEFT JOIN cls ON node = n LEFT JOIN cv USING (c)"""

ORACLES["op4_ngram_groups"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS v, a AS t FROM e UNION SELECT e.b, r.t FROM r JOIN e ON r.v = e.a),
k AS (SELECT v, min(t) AS t FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.t, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.v = d.doc_id"""
