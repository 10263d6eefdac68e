"""Judging URLs by host and path rules and by a list of canonical URLs.

The list may be as large as the pages. A blocked Bloom filter of fixed maximal
size (``MAX_BLOCKS`` blocks of 256 bits, 8 MB) is built from it by a grouped
bit-or and broadcast; a page touches one block. Pages that pass are possible hits
and are joined with the list by hash; the join removes false positives, so the
verdicts are exact at any fill. Beyond some four million listed URLs the filter
passes more and more, and the join does the work. One URL that many pages
share is salted in that join.

Null URLs and those without ``://`` have an empty host and path and are never
listed. Repeated pages are judged one by one; empty tables give no rows; a null
or empty list blocks nothing. Other columns are left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespark.operators.joins import heavy_keys, salted_join
from rarespark.session import materialize

BITS_PER_URL = 16
MIN_BLOCKS, MAX_BLOCKS = 64, 1 << 18
# rules become one chain of conditions; longer lists belong into the listed URLs
MAX_RULES = 256


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without port, ``www.`` and ``m.``; path without trailing slashes and
    ``.html``; query without ``utm_`` parameters; no scheme, no fragment."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r":[0-9]*$", ""), r"^(www\.|m\.)", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"/+$", ""), r"\.html$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), r"&utm_[^&]*", ""), r"^&", "")
    return F.when(host == "", F.lit(None)).otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _place(df: DataFrame, url: str, blocks: int) -> DataFrame:
    """Block of a canonical URL and its bits in the four words of the block, two in each."""
    df = df.withColumn("_h", F.xxhash64(F.col(url), F.lit("bits"))).withColumn("_block", F.pmod(F.xxhash64(url), F.lit(blocks)))
    for i in range(4):
        one = [f"shiftleft(1L, CAST(shiftrightunsigned(_h, {12 * i + s}) & 63 AS INT))" for s in (0, 6)]
        df = df.withColumn(f"_m{i}", F.expr(f"{one[0]} | {one[1]}"))
    return df.drop("_h")


def bloom_blocks(listed: DataFrame, url: str, rows: int) -> tuple[DataFrame, int]:
    """Blocks with at least one listed URL, and the number of blocks."""
    wanted = max(MIN_BLOCKS, min(MAX_BLOCKS, rows * BITS_PER_URL // 256))
    blocks = 1 << (wanted - 1).bit_length()
    words = [F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(4)]
    return _place(listed, url, blocks).groupBy("_block").agg(*words), blocks


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, listed_url: str = "url") -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, listed)`` for every page: the
    longest rule decides, else ``block`` if the canonical URL is listed."""
    known = listed.select(canonical_url(F.col(listed_url).cast("string")).alias("_url")).where("_url IS NOT NULL").distinct()
    known = materialize(known, "listed-urls")
    blocks, n_blocks = bloom_blocks(known, "_url", known.count())

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("_url", canonical_url(F.col("url")))
    found = _place(rows, "_url", n_blocks).join(F.broadcast(blocks), "_block", "left")
    passed = F.lit(True)
    for i in range(4):
        passed &= F.col(f"_w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}")
    possible = F.col("verdict").isNull() & F.col("_url").isNotNull() & F.coalesce(passed, F.lit(False))
    columns = ["page_id", "url", "host", "path", "rule", "verdict"]

    out = F.coalesce("verdict", F.lit("allow")).alias("verdict")
    sure = found.where(~possible).select(*columns[:-1], out, F.lit(False).alias("listed"))
    hits = found.where(possible).select(*columns, "_url")
    heavy = heavy_keys(hits, "_url")
    exact = salted_join(hits, known.withColumn("listed", F.lit(True)), ["_url"], heavy, "_url", F.col("page_id"), "left")
    yes = F.coalesce("listed", F.lit(False))
    decided = exact.select(*columns[:-1], F.when(yes, "block").otherwise("allow").alias("verdict"), yes.alias("listed"))
    return sure.unionByName(decided)
