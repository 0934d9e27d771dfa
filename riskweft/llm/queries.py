"""The registered queries of this package, each over the whole of its table, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweft.llm import (
    bpe, covertree, decontaminate, hardneg, htmltext, langid, lmscore, ngramjoin, quality, simhash, toxicity, trie, urls,
)
from riskweft.llm.store import crc_of_id, read, stored

TOXIC_FROM = 0.7
GOOD_FROM = 0.3
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary_path() -> str:
    """The public vocabulary file of this machine; RISKWEFT_VOCABULARY names another."""
    given = os.environ.get("RISKWEFT_VOCABULARY")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select(
        "vec_id", covertree.quantised(F.col("embedding")).alias("vector")
    )
    return covertree.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held_out = crc_of_id() % 3 == 1
    filters = langid.fit_filters(docs.filter(~held_out))
    judged = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)
    return judged.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held_out = crc_of_id() % 5 == 0
    field = quality.fit_quality(toxicity.labelled_sample(docs, labels.filter(~held_out), "quality", quality.SAMPLE))
    judged = quality.score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), field)
    score = F.col("quality_score")
    return judged.select("doc_id", "held_out", score.alias("score"), (score >= GOOD_FROM).cast("int").alias("predicted"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    scores = lmscore.lm_scores(read(spark, folder, "documents"))
    return scores.withColumn("lm_score", F.round("lm_score", 6))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urls.judge_urls(read(spark, folder, "pages"), rules)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    made = bpe.encode(docs, vocabulary_path(), keep_ids=False)
    return made.select(
        "doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"),
        F.col("bpe_decoded_sha256").alias("decoded_sha256"),
    )


def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held_out = crc_of_id() % 3 == 1
    model = toxicity.fit_toxicity(toxicity.labelled(docs, labels.filter(~held_out), "toxic"))
    judged = toxicity.score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    score = F.col("toxicity")
    return judged.select("doc_id", "held_out", score.alias("score"), (score >= TOXIC_FROM).cast("int").alias("predicted"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.render_pages(read(spark, folder, "pages").select("page_id", "url", "html"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.ngram_jaccard(read(spark, folder, "documents"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.ordered_turns(read(spark, folder, "conversations"))
    return trie.prefix_trie(trie.with_openings(stored(turns, "turns")))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), shifted.alias("label"), covertree.quantised(F.col("embedding")).alias("vector")
    )
    return hardneg.hard_negatives(vectors, vectors.filter("id % 50 = 0").select("id"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_cover_tree_topk": op1,
    "op2_decontaminate": op2,
    "op3_simhash": op3,
    "op4_language_id": op4,
    "op5_quality_crf": op5,
    "op6_stupid_backoff": op6,
    "op7_url_filter": op7,
    "op8_bpe": op8,
    "op9_toxicity": op9,
    "op10_html_text": op10,
    "op11_ngram_jaccard": op11,
    "op12_prefix_trie": op12,
    "op13_hard_negatives": op13,
    "pipeline": pipeline,
}

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

_URL = "'(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?'"


def _host(url: str) -> str:
    return (
        f"translate(coalesce(regexp_extract({url}, {_URL}, 1), ''),"
        " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, {_URL}, 2), '')"


def _normal(url: str) -> str:
    query = (
        f"list_sort(list_filter(string_split(substr(regexp_extract({url}, {_URL}, 3), 2), '&'), lambda p: "
        f"len(p) > 0 AND NOT regexp_matches(p, '{urls._VISIT}')))"
    )
    return (
        f"CASE WHEN contains({url}, '://') THEN regexp_replace({_host(url)}, ':(80|443)$', '')"
        f" || regexp_replace({_path(url)}, '/+$', '') || CASE WHEN len({query}) > 0"
        f" THEN '?' || array_to_string({query}, '&') ELSE '' END END"
    )


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)

_URL_SQL = f"""
WITH RECURSIVE rules(rule_host, rule_path, action) AS (VALUES {_RULE_ROWS}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages
  WHERE contains(url, '://')),
links AS (SELECT url, replace(trim(regexp_extract(tag, '(?is)(?:href|url)\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1)),
    '&amp;', '&') AS target FROM tags
  WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
     OR regexp_matches(tag, '(?i)http-equiv\\s*=\\s*["'']?refresh\\b')),
edges AS (SELECT url AS source, CASE
    WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://'
      || regexp_extract(url, {_URL}, 1) || target
    ELSE regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || regexp_extract(url, {_URL}, 1)
      || coalesce(nullif(regexp_replace({_path('url')}, '[^/]*$', ''), ''), '/') || target END AS target
  FROM links WHERE target <> ''),
named AS (SELECT url FROM pages UNION SELECT source FROM edges UNION SELECT target FROM edges),
judged AS (SELECT url, {_host('url')} AS host, {_path('url')} AS path, {_normal('url')} AS node FROM named),
ruled AS (SELECT j.*, r.rule, r.action FROM judged j LEFT JOIN (
  SELECT url, rule, action FROM (
    SELECT url, rule_host || rule_path AS rule, action, row_number() OVER (
      PARTITION BY url ORDER BY len(rule_host || rule_path) DESC, rule_host || rule_path) AS k
    FROM judged JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
      AND starts_with(path, rule_path)) WHERE k = 1) r ON r.url IS NOT DISTINCT FROM j.url),
pairs AS (SELECT a.node AS u, b.node AS v FROM edges
  JOIN judged a ON a.url = source JOIN judged b ON b.url = target WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(node, seen) AS (SELECT node, node FROM judged WHERE node IS NOT NULL
  UNION SELECT reach.node, v FROM reach JOIN both_ways ON seen = u),
part AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
word AS (SELECT component, bool_or(action = 'allow') AS allowed, bool_or(action = 'block') AS blocked
  FROM part JOIN ruled USING (node) GROUP BY component)
SELECT p.page_id, r.host, r.path, r.rule,
  CASE WHEN r.action IS NOT NULL THEN r.action WHEN coalesce(allowed, false) THEN 'allow'
       WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict, part.component
FROM pages p JOIN ruled r ON r.url IS NOT DISTINCT FROM p.url
LEFT JOIN part ON part.node = r.node LEFT JOIN word USING (component)
"""

ORACLES = {
    "op1_cover_tree_topk": _TOP_K_SQL,
    "op6_stupid_backoff": lmscore.LM_SCORE_SQL,
    "op7_url_filter": _URL_SQL,
    "op11_ngram_jaccard": ngramjoin.NGRAM_JACCARD_SQL,
    "op12_prefix_trie": trie.TRIE_SQL,
    "op13_hard_negatives": hardneg.HARD_NEGATIVE_SQL,
}
