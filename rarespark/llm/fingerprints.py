"""Bottom-k fingerprints of documents, with DataFrame functions only.

A fingerprint is the sorted array of the ``K`` smallest distinct 48-bit hashes of
a text's five-word shingles (words are runs of characters other than ASCII white
space). A text with fewer words has its whole word sequence as its only shingle;
one without words has an empty fingerprint. Fingerprints of parts merge into that of
the whole; two of them estimate resemblance and containment; one estimates the
number of distinct shingles, exactly below ``K``.

Null text counts as empty. Two empty fingerprints are alike (1), an empty and
another are not (0). Rows with equal ``doc_id`` follow each other in the order of their
texts' hashes; null ids come last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.llm.rows import keyed, parts_for
from rarespark.operators.ordering import with_range

K = 128
SHINGLE = 5
HASH_BITS = 48
RANGE_ROWS = 2_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column) -> Column:
    """48-bit hashes of the shingles, with repeats."""

    def of(words: Column) -> Column:
        cut = lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)
        one = lambda i: cut(F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
        every = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), one)
        few = F.array(cut(F.xxhash64(F.lit("all"), words)))
        return F.when(F.size(words) >= SHINGLE, every).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return _let(words, of)


def fingerprint(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(df: DataFrame, by: list[str], fp: str, k: int = K) -> DataFrame:
    """Fingerprint of all rows of a group. Every task passes on at most ``k`` hashes
    of a group, so a hot group costs no more than another."""
    hashes = df.select(*by, F.explode(fp).alias("_h")).distinct()
    lowest = Window.partitionBy(*by).orderBy("_h")
    ranked = hashes.withColumn("_rank", F.row_number().over(lowest)).where(F.col("_rank") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(fp))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the ``k`` smallest hashes of the union that both have."""

    def of(lowest: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(lowest, a), b))
        return F.when(F.size(lowest) > 0, both / F.size(lowest)).otherwise(F.lit(1.0))

    return _let(merge(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if ``a`` has none."""

    def of(lowest: Column) -> Column:
        own = F.array_intersect(lowest, a)
        return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(F.when(F.size(a) > 0, 0.0).otherwise(1.0))

    return _let(merge(a, b, k), of)


def distinct_shingles(fp: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    last = F.element_at(fp, k) / F.lit(float(1 << HASH_BITS))
    return F.when(F.size(fp) < k, F.size(fp).cast("double")).otherwise((k - 1) / last)


def as_text(fp: Column) -> Column:
    digits = HASH_BITS // 4
    return F.concat_ws("", F.transform(fp, lambda h: F.lpad(F.lower(F.hex(h)), digits, "0")))


def with_next_text(docs: DataFrame, total: int) -> tuple[DataFrame, Window]:
    """Documents with the text ``_next`` of the next one in descending order of
    ``doc_id``; after the last comes the first. No window spans the table: rows lie in
    ranges of ids, and each range also gets the highest row of the range below."""
    ranged = with_range(keyed(docs), [], "_id", parts_for(total, RANGE_ROWS)).withColumn("_extra", F.lit(False))
    top = F.max_by(F.struct("_id", "_th", "text"), F.struct("_id", "_th"))
    heads = ranged.groupBy("_range").agg(top.alias("_top"))
    # the windows see numbers of ranges only, the texts stay where they are
    ranges = Window.orderBy("_range")
    above = F.coalesce(F.lead("_range").over(ranges), F.min("_range").over(Window.partitionBy()))
    steps = ranged.select("_range").distinct().select("_range", above.alias("_above"))
    moved = heads.join(steps, "_range").select(
        "_top.text", "_top._id", "_top._th", F.col("_above").alias("_range"), F.lit(True).alias("_extra"), F.lit(None).cast("bigint").alias("doc_id")
    )
    order = Window.partitionBy("_range").orderBy("_extra", F.desc("_id"), F.desc("_th"))
    rows = ranged.select("doc_id", "text", "_id", "_th", "_range", "_extra").unionByName(moved)
    return rows.withColumn("_next", F.lead("text").over(order)), order


def compare_with_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text (the second half replaced by the
    beginning of the next document), and the likeness to the edited and to the next text."""
    rows, order = with_next_text(docs, docs.count())
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring(F.coalesce("_next", F.lit("")), 1, half))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("_edited", edited).drop("_next")
    rows = rows.withColumn("_fp", fingerprint(F.col("text"), k)).withColumn("_efp", F.when(~F.col("_extra"), fingerprint(F.col("_edited"), k)))
    rows = rows.withColumn("_nfp", F.lead("_fp").over(order)).where(~F.col("_extra"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("_fp")).alias("fingerprint"), as_text(F.col("_efp")).alias("edited_fingerprint"),
        resemblance(F.col("_fp"), F.col("_efp"), k).alias("near_edited"), resemblance(F.col("_fp"), F.col("_nfp"), k).alias("near_next"),
        distinct_shingles(F.col("_fp"), k).alias("distinct_shingles"),
    )
