import importlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rarespark.llm.queries import QUERIES, SQL
from tests.compare import difference, duck
from tests.llm.odd import no_documents, odd_documents, word
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_near
from tests.llm.test_packing import check as check_packing

ROOT = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")
STAGES = dict(corpus_pipeline.STAGES)


def prose(i):
    return "\n".join(" ".join(word((i * 131 + j * 17 + k * 7) % 4001) for k in range(30)) for j in range(4))


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, prose(i), f"s{i % 3}", "en") for i in range(60)]
    rows += [(100 + i, prose(i), "copy", "en") for i in range(5)]
    rows += [(200 + i, prose(i).replace("treeb", "q", 1), "near", "en") for i in range(5)]
    rows += [(300, "### " * 80, "junk", "en"), (301, "BUY!! NOW!! " * 60, "junk", "en"), (302, "few", "junk", "en"), (303, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("n_chars", F.length("text").cast("bigint"))


def test_each_stage_on_what_the_one_before_kept(spark, documents):
    docs, pairs = documents, lambda d: [(r.doc_id, r.text) for r in d.collect()]
    good = STAGES["quality"](spark, docs, "")
    assert {r.doc_id for r in good.collect()} == {i for i in range(300) if i < 60 or 100 <= i < 105 or 200 <= i < 205}
    kept = STAGES["lines"](spark, good, "")
    assert dict(pairs(kept)) == brute_lines(pairs(good))
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    # near-duplicates are looked at on their own, with the copies still whole
    one = STAGES["near_duplicates"](spark, good, "")
    low = {(d, n): c for d, n, c in brute_near(pairs(good))}
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for (d, _), c in low.items() if c == d)
    mixed = STAGES["mixture"](spark, one, "")
    assert set(pairs(mixed)) == set(pairs(one))
    for stage in (good, kept, one, mixed):
        assert stage.columns == docs.columns
    packed = STAGES["packing"](spark, mixed, "")
    from rarespark.llm.packing import piece_rows

    check_packing(pairs(mixed), piece_rows(packed).collect())


@needs_tables
def test_whole_run(spark):
    sequences = corpus_pipeline.run(spark, ROOT)
    assert sequences.count() > 0 and sequences.where("n_tokens > 2048").count() == 0
    assert QUERIES and [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "packing"]


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_cope_with_odd_rows(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").collect()


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    got = QUERIES[name](spark, ROOT).toPandas()
    assert difference(got, duck(ROOT).execute(SQL[name]).df()) is None


def test_entry_lists_all():
    entry = importlib.import_module("__spark_entry__")
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
