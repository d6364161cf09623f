"""The query of each operator with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith.llm import byte_bpe, html_extract, mixing, ngram_join, pii_crf, pivot_topk, quality_mil, stream_dedup, token_counts, url_reputation
from corrolith.llm.common import table

#: Where the vocabularies lie; on every worker.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


#: Documents that score at least so much are kept.
GOOD = 0.7


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_mil.Model:
    """Learns from the labels of documents that are not held out."""
    return quality_mil.fit(docs, labels.filter(~quality_mil.held_out("doc_id")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_mil.score_documents(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_mil.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.learn_weights(pages))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source", "key")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.labelled_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_reputation.judge_urls(pages, outcomes)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), RANKS)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_quality, op3_html_text, op4_exact_dedup, op5_mix_sources, op6_ngram_join, op7_url_filter, op8_exact_topk, op9_byte_bpe, op10_personal_data]
    return {f.__name__: f for f in own}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256, {LOWERED} AS body FROM documents),
r AS (SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
      row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) AS place FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 10) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(2 * source_size AS BIGINT) AS cap, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
t AS (SELECT 1.5 * sum(source_size) AS total FROM w),
step AS (
  SELECT 0 AS n, CAST((SELECT CAST(total AS DOUBLE) / sum(weight) FROM t, w GROUP BY total) AS DOUBLE) AS level
  UNION ALL
  SELECT n + 1, (SELECT (CAST(total AS DOUBLE) - sum(CASE WHEN cap < weight * level THEN cap ELSE 0 END)) / nullif(sum(CASE WHEN cap < weight * level THEN 0 ELSE weight END), 0) FROM w, t GROUP BY total)
  FROM step WHERE n < (SELECT count(*) FROM w) AND level IS NOT NULL),
l AS (SELECT max(level) AS level FROM step),
g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM w, l),
p AS (SELECT doc_id, d.source, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(greatest(CAST(floor(target) AS BIGINT) - whole * source_size - before, 0), size) AS BIGINT) AS taken FROM c
"""

_HOST = r"translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(value: str) -> str:
    fits = lambda r: f"((host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}'))"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{(v, r)[value == 'rule']}'" for v, r in sorted(url_reputation.RULES, key=lambda x: -len(x[1]))) + " END"


def _op7() -> str:
    """Rules, labelled outcomes by whole texts, posteriors from host to domain to suffix to all pages, and the bound."""
    bare = lambda x: rf"regexp_replace({x}, '[\x20\x09-\x0D\x{{A0}}]+', '', 'g')"
    inside = lambda name: rf"nullif(regexp_extract(html, '(?si)<{name}\b[^>]*>(.*)</{name}\s*>', 1), '')"

    def visible(x: str) -> str:
        out = rf"regexp_replace({x}, '(?si)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>', ' ', 'g')"
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
            out = f"replace({out}, '{entity}', '{char}')"
        return out

    second = ", ".join(f"'{x}'" for x in url_reputation.SECOND_LEVEL)
    name = r"regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '')"
    last = lambda k: f"array_to_string(list_slice(string_split(name, '.'), -{k}, -1), '.')"
    address = r"(regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') OR starts_with(name, '['))"
    double = f"(regexp_matches({last(1)}, '^[a-z]{{2}}$') AND list_extract(string_split(name, '.'), -2) IN ({second}))"

    def strength(t: str) -> str:
        return f"""(SELECT round(least(greatest(CASE WHEN m * (1 - m) > 0 AND room > 0 AND spread / (m * (1 - m)) - (g - 1) > 0 THEN room / (spread / (m * (1 - m)) - (g - 1)) - 1 ELSE 1000.0 END, 1.0), 1000.0), 3)
  FROM (SELECT any_value(m) AS m, sum(n * (bad / n - m) * (bad / n - m)) AS spread, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, count(*) AS g FROM {t}, (SELECT sum(bad) / sum(n) AS m FROM {t}) WHERE n > 0))"""

    return f"""
WITH marks AS (SELECT doc_id, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END AS bad FROM labels),
known AS (SELECT key, count(*) AS labels, sum(bad) AS bad FROM (SELECT doc_id, {bare('text')} AS key FROM documents) JOIN marks USING (doc_id) WHERE key <> '' GROUP BY key),
p AS (SELECT page_id, {_HOST.format('url')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
whole AS (SELECT host, coalesce({inside('article')}, {inside('main')}, {inside('body')}, html) AS whole FROM p WHERE html IS NOT NULL),
shown AS (SELECT host, unnest(list_distinct([{bare(visible('whole'))}, {bare(visible(r"regexp_replace(whole, '(?si)^.*?<h1\b[^>]*>.*?</h1\s*>', '')"))}])) AS key FROM whole),
pages_of AS (SELECT host, key, count(*) AS pages FROM shown WHERE key <> '' GROUP BY host, key),
outcomes AS (SELECT host, CAST(sum(pages) AS DOUBLE) AS n, CAST(sum(CAST(CAST(pages * k.bad AS DOUBLE) / labels AS DECIMAL(28, 9))) AS DOUBLE) AS bad FROM pages_of JOIN known k USING (key) GROUP BY host),
named AS (SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, {name} AS name FROM (SELECT DISTINCT host FROM p) LEFT JOIN outcomes USING (host)),
hosts AS (SELECT host, n, bad, CASE WHEN {address} THEN name WHEN {double} THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {address} THEN name WHEN {double} THEN {last(2)} ELSE {last(1)} END AS suffix FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
k AS (SELECT {strength('suffixes')} AS ks, {strength('domains')} AS kd, {strength('hosts')} AS kh, (SELECT sum(bad) / sum(n) FROM suffixes) AS m),
ps AS (SELECT suffix, (bad + ks * m) / (n + ks) AS p FROM suffixes, k),
pd AS (SELECT domain, (bad + kd * p) / (n + kd) AS p FROM domains JOIN ps USING (suffix), k),
ph AS (SELECT host, n, (bad + kh * p) / (n + kh) AS p, kh FROM hosts JOIN pd USING (domain), k),
blocked AS (SELECT host FROM ph WHERE p - 2.0 * sqrt(p * (1 - p) / (n + kh + 1)) > 0.5)
SELECT page_id, host, path, {_rule('rule')} AS rule, coalesce({_rule('verdict')}, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""


OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS x FROM d),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c m ON m.doc_id = a JOIN c n ON n.doc_id = b WHERE 100 * i >= 80 * (m.n + n.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.o AS component_id FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4, "op5_mix_sources": OP5, "op6_ngram_join": OP6, "op7_url_filter": _op7(), "op8_exact_topk": OP8}
