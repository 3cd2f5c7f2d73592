"""Operator 8, URL filters: a blocked Bloom filter before an exact hash join, with DataFrame functions only.

The filter is a table of `blocks` 64-bit words. A key picks one word and sets `BITS` bits of it, so a probe touches one word only. The
table is built with one bit_or per word. It has at most MAX_BLOCKS rows whatever the list holds, so it may be broadcast: a
longer list only lets more false hits through to the join, which decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BITS = 6
MAX_BLOCKS = 1 << 16


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty where it is null or has no `://`."""
    rest = F.when(url.contains("://"), F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.locate("/", rest)
    return F.coalesce(host, F.lit("")), F.coalesce(F.when(cut > 0, rest.substr(cut, F.length(rest))).otherwise(""), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Key of a page: host without a leading `www.`, path without an ending `/`, `.html` or `.htm`."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html?|/+)$", ""))


def _word_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", h, F.lit(16 + 6 * k)).bitwiseAND(63).cast("int")))
    return F.pmod(h, F.lit(blocks)).cast("int"), mask


def bloom(listed: DataFrame, key: str, blocks: int = MAX_BLOCKS) -> DataFrame:
    """word, bits: the filter of the keys of `listed`."""
    word, mask = _word_and_mask(F.col(key), blocks)
    return listed.where(F.col(key).isNotNull()).select(word.alias("word"), mask.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def is_listed(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, blocks: int = MAX_BLOCKS) -> DataFrame:
    """`rows` plus boolean `listed`: whether the key is on the list. Exact; a null key is not listed.

    Rows are joined with the words of the filter; distinct keys that hit are semi-joined with the list, which ships each key once
    however often it occurs, and what is left is joined back.
    """
    if blocks > MAX_BLOCKS:
        raise ValueError(f"blocks must be at most {MAX_BLOCKS}")
    word, mask = _word_and_mask(F.col(key), blocks)
    hit = rows.withColumn("_w", word).join(F.broadcast(bloom(listed, listed_key, blocks).select(F.col("word").alias("_w"), "bits")), "_w", "left").withColumn(
        "_hit", F.col(key).isNotNull() & F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_w", "bits")
    found = hit.where("_hit").select(F.col(key).alias("_k")).distinct().join(listed.select(F.col(listed_key).alias("_k")).distinct(), "_k", "left_semi")
    found = found.withColumn("_f", F.lit(True))
    return hit.join(found, (F.col("_hit") == F.col("_f")) & (F.col(key) == F.col("_k")), "left").withColumn("listed", F.coalesce("_f", F.lit(False))).drop("_hit", "_k", "_f")


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path as written) and verdict of the longest rule (verdict, host, path) that fits, or nulls.

    A rule fits its host and all its subdomains where the path starts with the rule's. Of two rules of equal length the later stands.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row of `pages`; listed: column `key` of canonical urls, repeated ones count once.

    A rule's verdict goes first, then `block` for a listed url and `allow` for any other; so a null url is allowed by the method.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("key", canonical(F.col("host"), F.col("path"))).drop("url")
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    return is_listed(rows, "key", listed, "key", blocks).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
