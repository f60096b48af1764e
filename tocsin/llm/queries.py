"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import combination_join, hard_negatives, language, near_duplicates, neighbours, packing, pieces, prefix_trie, pseudonyms, secret_scan, token_counts, urls, winnowing
from .common import sha256_of_ids

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
PSEUDONYM_KEY = b"tocsin"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    out = pieces.encode(documents(spark, sf_dir), model, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_of_ids(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_tokens(docs)))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.KINDS[3])
    return found.select("doc_id", *counts[:3], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), counts[3])


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of each document: 40 code points in its middle give way to its first
    20, then its first 20 code points are put in again at a third of it."""
    path = public_tokenizers.path(BYTES)
    trees = token_counts.grow(documents(spark, sf_dir), path)
    n, head = F.length("text"), F.substring("text", 1, 20)
    change = lambda start, deleted: F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), head.alias("inserted"))
    edited = token_counts.recount(trees.withColumn("edits", F.array(change(F.floor(n / 2), 40), change(F.floor(n / 3), 0))).withColumn("before", F.col("n_tokens")), path, keep=("before",))
    return edited.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), F.size("leaf_tokens").cast("long").alias("n_leaves"), "n_read", F.sha2("text", 256).alias("edited_sha256"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language.train(docs.where(~held_out()))
    return language.predict(docs, profiles, keep=held_out())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(BYTES))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(documents(spark, sf_dir))


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = winnowing.with_next(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda g: F.concat_ws(":", g["position"], F.lower(F.hex(g["hash"])))), ",")
    return compared.withColumns({c: joined(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonyms(documents(spark, sf_dir), PSEUDONYM_KEY)
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pseudonyms.KINDS]
    return found.select("doc_id", *counts, joined_spans(F.col("spans")).alias("spans"), "text")


#: The rules, and the words of host names whose pages are listed.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED_WORDS = "casino|bets|adult|pills|loans|xxx"


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the URLs of pages on hosts with one of the words in their names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where(F.regexp_extract("url", "://([^/?#]*)", 1).rlike(f"(?i)(^|[.-])({LISTED_WORDS})([.-]|$)"))
    return urls.judge(pages, listed, RULES)


ORACLES["op10_urls"] = rf"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, '&' || regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM split),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_replace(path, '(\.html)?/*$', ''), '/+', '/', 'g')
    || array_to_string(list_transform(list_filter(string_split(query, '&'), lambda p, k: k > 1 AND NOT regexp_full_match(p, '({urls.TRACKING})=.*')), lambda p: '&' || p), '') END AS page,
    CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN page IN (SELECT page FROM canon WHERE page IS NOT NULL AND regexp_matches(host, '(^|[.-])({LISTED_WORDS})([.-]|$)')) THEN 'block' ELSE 'allow' END AS verdict
FROM canon"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH points AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM points a JOIN points c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.q) = len(c.q)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that share first turns are made from the table: up to five of each
    are those of the conversation with the next lower multiple of 100."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = F.col("conv_id")
    return prefix_trie.trie(*prefix_trie.with_shared_heads(talks, c - c % 100, F.crc32(c.cast("string")) % 6, 5))


ORACLES["op11_prefix_trie"] = """
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(conv_id::VARCHAR))),
    lambda crc, j: CASE WHEN xor(crc, CASE WHEN j % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, j // 8 + 1, 1)) ELSE 0 END) & 1 = 1
      THEN xor(xor(crc, CASE WHEN j % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, j // 8 + 1, 1)) ELSE 0 END) >> 1, 3988292384)
      ELSE xor(crc, CASE WHEN j % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, j // 8 + 1, 1)) ELSE 0 END) >> 1 END)) % 6 AS h
  FROM ordered GROUP BY conv_id),
heads AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM sizes c LEFT JOIN sizes b ON b.conv_id = c.base),
rebuilt AS (
  SELECT s.conv_id, o.i AS pos, o.role, o.text FROM heads s JOIN ordered o ON o.conv_id = s.base AND o.i <= s.m
  UNION ALL SELECT s.conv_id, o.i - s.h + s.m, o.role, o.text FROM heads s JOIN ordered o ON o.conv_id = s.conv_id AND o.i > s.h),
paths AS (
  SELECT conv_id, pos AS depth, length(text) AS chars, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM sizes),
nodes AS (SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY depth, path),
up AS (SELECT v.conv_id, v.depth, v.path, u.conv_id AS parent_conv_id, u.path AS parent FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1 JOIN nodes u ON u.depth = p.depth AND u.path = p.path),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n FROM up GROUP BY ALL),
below AS (
  SELECT v.depth, v.path, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens
  FROM nodes v JOIN paths p ON p.depth = v.depth AND p.path = v.path JOIN nodes u ON u.conv_id = p.conv_id AND u.depth >= v.depth
  LEFT JOIN kids k ON k.depth = u.depth AND k.path = u.path GROUP BY v.depth, v.path),
ends AS (SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY depth, path)
SELECT v.conv_id, v.depth, up.parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN below b USING (depth, path) LEFT JOIN up USING (depth, path) LEFT JOIN kids k ON k.depth = v.depth AND k.path = v.path LEFT JOIN ends e ON e.depth = v.depth AND e.path = v.path"""


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combination_join.join(documents(spark, sf_dir), words=3, similarity=90)
