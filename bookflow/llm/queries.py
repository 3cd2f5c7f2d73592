"""The registered queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookflow.llm import bpe, decontam, jaccard, phrases, prefix_trie, quality, sharding, simhash, substrings, token_files, toxicity, url_filter, whitening
from bookflow.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules of the URL query (fixed values).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Labels of hosts whose pages make the list of the URL query.
LISTED_HOSTS = ["adult-x", "ads-track", "casino-win", "free-bets", "spam-farm"]


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place, as a URI."""
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/bookflow/{label}-{uuid.uuid4().hex}"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is 2 modulo 4; a null id has none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    manifest = token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_documents(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), folder(spark, "slot-map"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """key: canonical urls of all pages on hosts with a listed label."""
    host, path = url_filter.host_path(F.col("url"))
    of_list = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_HOSTS)))
    return pages.select(host.alias("host"), path.alias("path")).where(of_list).select(url_filter.canonical(F.col("host"), F.col("path")).alias("key")).distinct()


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages.select("page_id", "url"), listed_urls(pages), RULES)


ORACLES["op8_urls"] = """
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM r
), k AS (
  SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html?|/+)$', '') AS key FROM p
), l AS (
  SELECT DISTINCT key FROM k WHERE list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'free-bets', 'spam-farm'])
), j AS (
  SELECT page_id, host, path, key IN (SELECT key FROM l) AS listed, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'allow www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'block example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'block net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'block net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'allow com/' END AS hit FROM k)
SELECT page_id, host, path, substr(hit, 7) AS rule, coalesce(substr(hit, 1, 5), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j
"""


@query
def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents"))


@query
def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), decontam.halves(table(spark, sf_dir, "benchmark")))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"), k=16)


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return trie.withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256))).drop("ends")


# CRC-32 of the decimal id, bit by bit: no such function in the twin's engine.
_BITS = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, s: " + _BITS.format(x="xor(a, s)") + "), 4294967295)"
ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY turn NULLS FIRST) AS xs, {_CRC} % 9 AS h FROM t GROUP BY c),
rebuilt AS (SELECT o.c, list_concat(coalesce(b.xs[1:o.h], []), o.xs[o.h + 1:]) AS s FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5),
pre AS (SELECT c, d, s[1:d] AS k, d = len(s) AS last, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS b FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, array_to_string(coalesce(list(CAST(c AS VARCHAR) ORDER BY c) FILTER (last), []), ',') AS ends, any_value(b) AS b FROM pre GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]),
sub AS (SELECT x.d, x.k, sum(CASE WHEN y.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((y.n_convs - 1) * y.b) AS saved FROM a x JOIN a y ON y.d >= x.d AND y.k[1:x.d] = x.k GROUP BY x.d, x.k)
SELECT conv_id, a.d AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM a JOIN sub ON sub.d = a.d AND sub.k = a.k
"""
