import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from rarespark.llm.fingerprints import K, compare_with_edited, containment, distinct_shingles, fingerprint, merge, merge_rows, resemblance
from tests.llm.odd import ROWS, no_documents, odd_documents, text_of


def hashes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def of(run, seed):
        for word in run:
            seed = xxhash.xxh64_intdigest(word.encode(), seed)
        return seed >> 16

    if len(words) >= 5:
        return {of(words[i : i + 5], 42) for i in range(len(words) - 4)}
    return {of(["all", *words], 42)} if words else set()


def lowest(found):
    return sorted(found)[:K]


def likeness(a, b):
    union = lowest(set(a) | set(b))
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(text_of(r).encode(), 42)))
    ordered = sorted(rows, key=key, reverse=True)
    out = []
    for i, row in enumerate(ordered):
        text, after = text_of(row), text_of(ordered[(i + 1) % len(ordered)])
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, behind = (lowest(hashes(t)) for t in (text, edited, after))
        said = lambda f: "".join(f"{h:012x}" for h in f)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((str(row[0]), len(text), digest, said(own), said(other), round(likeness(own, other), 9), round(likeness(own, behind), 9)))
    return sorted(out)


def answers(df):
    rows = compare_with_edited(df).collect()
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


def test_against_brute_force(spark, monkeypatch):
    from rarespark.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    assert answers(odd_documents(spark)) == brute(ROWS)
    rows = [(i * i - 50, " ".join(f"t{(i * k) % 37}" for k in range(i % 23))) for i in range(60)]
    assert answers(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_one_row_and_none(spark):
    assert answers(odd_documents(spark).where("doc_id = 1")) == brute(ROWS[:1])
    assert compare_with_edited(no_documents(spark)).count() == 0


def test_estimates(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(1500, 4500))
    part = " ".join(f"w{i}" for i in range(500, 1500))
    df = spark.createDataFrame([(a, b, part)], "a string, b string, c string").select(*[fingerprint(F.col(c)).alias(c) for c in "abc"])
    r = df.select(
        resemblance(F.col("a"), F.col("b")).alias("ab"), containment(F.col("c"), F.col("a")).alias("ca"), containment(F.col("c"), F.col("b")).alias("cb"),
        distinct_shingles(F.col("a")).alias("n"), distinct_shingles(merge(F.col("a"), F.col("b"))).alias("both"),
    ).first()
    assert abs(r.ab - 1 / 3) < 0.13 and r.ca == 1.0 and r.cb < 0.1
    assert abs(r.n / 2996 - 1) < 0.3 and abs(r.both / 4496 - 1) < 0.3


def test_merged_rows_equal_the_whole(spark):
    rows = [(i % 2, " ".join(f"w{(i * 7 + k) % 211}" for k in range(40))) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, text string").withColumn("fp", fingerprint(F.col("text")))
    got = {r.g: r.fp for r in merge_rows(df, ["g"], "fp").collect()}
    for g in (0, 1):
        assert got[g] == lowest(set().union(*[hashes(t) for k, t in rows if k == g]))


def test_plan_has_no_python(spark):
    plan = compare_with_edited(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
