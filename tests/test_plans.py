"""What the physical plans must and must not contain."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from rarespark.operators.features import fit_features
from rarespark.operators.joins import heavy_keys, left_join_side, salted_join
from rarespark.operators.neighbors import distinct_vectors
from rarespark.operators.ordering import cumulative_counts
from rarespark.operators.split import fit_split
from rarespark.session import materialize, scratch_root


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.range(0, 4000, 1, 4).select(
        "id", (F.col("id") % 10 == 0).cast("int").alias("y"), (F.xxhash64("id") % 300).cast("string").alias("kind"),
        F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("unused"),
    )
    return materialize(df, "facts")


def test_split_moves_no_rows(facts):
    split = fit_split(facts, "id", "y")
    assert "Exchange" not in plan(split.assign(facts))


def test_split_reads_two_columns(facts):
    text = plan(fit_split(facts, "id", "y").assign(facts).select("id", "split"))
    assert "ReadSchema: struct<id:bigint,y:int>" in text


def test_small_lookups_are_broadcast_without_a_shuffle(facts):
    model = fit_features(facts, ["kind"], ["a", "b"])
    text = plan(model.transform(facts, ["id"], key="id"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "unused" not in text


def test_large_lookups_are_not_broadcast(facts):
    model = fit_features(facts, ["kind"], ["a"])
    text = plan(model.transform(facts, ["id"], key="id", broadcast_rows=10))
    assert "hashpartitioning" in text and "SinglePartition" not in text


def test_stored_splits_prune_partitions(facts):
    stored = materialize(fit_split(facts, "id", "y").assign(facts), "marked", ["split"])
    text = plan(stored.where("split = 'train'").select("a"))
    assert "PartitionFilters: [isnotnull(split" in text and "ReadSchema: struct<a:double>" in text


def test_running_counts_use_no_single_task(facts):
    scores = facts.select("y", F.col("a").alias("score"), F.lit("s").alias("scenario"))
    text = plan(cumulative_counts(scores, ["scenario"]))
    assert "SinglePartition" not in text and "_range" in text


def test_copies_are_limited_before_the_shuffle(facts):
    points = facts.select("id", F.array("a", "b").alias("vec")).withColumn("vkey", F.xxhash64("vec"))
    text = plan(distinct_vectors(points, 6))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_a_hot_key_is_spread(spark):
    left = spark.range(0, 6000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 2000).alias("k"))
    right = spark.range(-1, 1900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = heavy_keys(left, "k", share=0.01)
    assert [r["k"] for r in hot.collect()] == [-1]
    joined = salted_join(left, right, ["k"], hot, "k", F.col("id"), "left")
    assert joined.count() == 6000
    assert joined.where("k = -1 and v = -2").count() == 2000
    assert joined.where("k >= 1900 and v is not null").count() == 0
    assert joined.where("k between 0 and 1899 and v <> 2 * k").count() == 0
    assert "_salt" in plan(joined)


def test_every_fact_row_is_kept(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b")], "k int, f string")
    side = spark.createDataFrame([(2, 5)], "k int, s int")
    assert sorted(tuple(r) for r in left_join_side(fact, side, "k").collect()) == [(1, "a", None), (2, "b", 5)]


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
