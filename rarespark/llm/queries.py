"""Registered queries of the pipeline operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespark.llm.oracle import SQL
from rarespark.session import scratch_path

__all__ = ["QUERIES", "SQL"]


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.packing import pack_documents, piece_rows

    return piece_rows(pack_documents(read(spark, root, "documents"), vocabulary("word_bpe_49k.json")))


def op4_token_files(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.token_files import read_token_files, write_token_files

    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(read(spark, root, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    rows = read_token_files(spark, folder, manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# --- fixed values: rules, and words of hosts and beginnings of digests whose URLs are listed ---
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
LISTED_HOSTS = "casino|pills|bets|adult"
LISTED_DIGESTS = "0"
# --- end of fixed values ------------------------------------------------------


def op1_url_filter(spark: SparkSession, root: str) -> DataFrame:
    """The list holds the spellings of URLs whose md5 digest begins with ``LISTED_DIGESTS``, about one in
    16 on any host, and those on hosts with a listed word. Neither host nor canonical form tells whether
    a page is listed: other spellings of a listed page are found by the filter and the join only."""
    from rarespark.llm.url_filter import judge_urls, url_host

    pages = read(spark, root, "pages").select("page_id", "url")
    drawn = F.md5(F.encode("url", "UTF-8")).startswith(LISTED_DIGESTS)
    listed = pages.where(drawn | url_host(F.col("url")).rlike(LISTED_HOSTS))
    return judge_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.mixing import mix_slots

    return mix_slots(read(spark, root, "documents")).select("doc_id", "stream", "epoch", "block", "slot")


def op5_repeats(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.repeats import remove_repeats

    kept = remove_repeats(read(spark, root, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.chat import conversation_digests, format_conversations

    said = "</s>[INST] ok [/INST]"
    rows = read(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return conversation_digests(format_conversations(rows.unionByName(extra))).drop("rewrites_history")


def op7_near_dup(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.near_dup import near_duplicates

    return near_duplicates(read(spark, root, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(read(spark, root, "documents"))
    return kept.select("doc_id", "n_chars", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op9_quality(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.quality import judge_documents

    judged = judge_documents(read(spark, root, "documents"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged.select(*columns)


def op10_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.fingerprints import compare_with_edited

    return compare_with_edited(read(spark, root, "documents"))


def op11_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.lexical import ranked_search

    return ranked_search(read(spark, root, "documents"), read(spark, root, "benchmark").select("item_id", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows lost, emptied, cut, repeated and given another role, by a checksum of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, F.array_repeat(F.lit(1), 2)).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.repair import repair_conversations, repaired_digests

    rows = read(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    reports, pieces, audits = repair_conversations(damaged(rows))
    one = lambda df, name: df.select(F.col("conv_id").alias(name), *[c for c in df.columns if c != "conv_id"])
    every = rows.select("conv_id").distinct()
    same = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    whole = every.join(one(reports, "_a"), same("_a"), "left").join(one(repaired_digests(pieces, audits), "_b"), same("_b"), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op13_nearest(spark: SparkSession, root: str) -> DataFrame:
    from rarespark.llm.nearest import nearest_vectors

    return nearest_vectors(read(spark, root, "embeddings"), lambda i: F.pmod(i, F.lit(50)) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_repeats": op5_repeats,
    "op6_chat_format": op6_chat_format,
    "op7_near_dup": op7_near_dup,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_fingerprints": op10_fingerprints,
    "op11_ranked_search": op11_ranked_search,
    "op12_repair": op12_repair,
    "op13_nearest": op13_nearest,
}
