import pytest
from pyspark.sql import functions as F

from rarespark.functions.draws import draw_bits, uniform
from rarespark.operators import checks, split
from rarespark.operators.split import fit_split, synthetic_count
from rarespark.settings import SEED


def labelled(spark, n, every, partitions=4):
    return spark.range(0, n, 1, partitions).select(
        F.col("id").alias("k"), (F.col("id") % every == 0).cast("int").alias("y")
    )


@pytest.mark.parametrize("n,every", [(5000, 7), (37, 5), (6, 3), (4, 2)])
def test_sizes_are_exact_per_class(spark, n, every):
    df = labelled(spark, n, every)
    out = fit_split(df, "k", "y").assign(df)
    got = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for label in (0, 1):
        size = sum(1 for i in range(n) if (i % every == 0) == bool(label))
        train, valid = int(round(0.6 * size, 6)), int(round(0.2 * size, 6))
        assert got.get((label, "train"), 0) == train
        assert got.get((label, "validation"), 0) == valid
        assert got.get((label, "test"), 0) == size - train - valid


def test_order_is_that_of_the_hash(spark):
    df = labelled(spark, 3000, 11)
    out = fit_split(df, "k", "y", seed=3).assign(df).withColumn("u", uniform(3, "split", F.col("k")))
    for label in (0, 1):
        bounds = {
            r["split"]: (r["lo"], r["hi"])
            for r in out.where(F.col("y") == label).groupBy("split").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).collect()
        }
        assert bounds["train"][1] < bounds["validation"][0]
        assert bounds["validation"][1] < bounds["test"][0]


def test_independent_of_partitioning(spark):
    names = []
    for p in (1, 4, 16):
        df = labelled(spark, 2000, 9, p)
        names.append(fit_split(df, "k", "y").assign(df).orderBy("k").select("split").toPandas()["split"].tolist())
    assert names[0] == names[1] == names[2]


@pytest.mark.parametrize("bits,rows", [(2, 20), (3, 1), (12, 100_000)])
def test_wide_cells_are_counted_again(spark, monkeypatch, bits, rows):
    """The same split by any number of rounds; few rows are ranked."""
    df = labelled(spark, 3000, 8).unionByName(spark.createDataFrame([(5000, None)], "k bigint, y int"))
    whole = fit_split(df, "k", "y")
    rounds = []
    counted = split._cell_counts

    def counting(hashed, left):
        rounds.append(hashed.count())
        return counted(hashed, left)

    monkeypatch.setattr(split, "_cell_counts", counting)
    fine = fit_split(df, "k", "y", cell_bits=bits, cell_rows=rows)
    assert fine.cuts == whole.cuts
    assert len(rounds) > 2 if bits < 12 else len(rounds) == 1
    assert rounds == sorted(rounds, reverse=True) and rounds[0] == 3000
    hashes = df.where("y IS NOT NULL").select("y", "k", draw_bits(SEED, "split", F.col("k")).alias("h")).collect()
    for label in (0, 1):
        ordered = sorted((r.h, r.k) for r in hashes if r.y == label)
        n = len(ordered)
        assert fine.cuts[label] == [ordered[int(0.6 * n + 1e-6) - 1], ordered[int(0.6 * n + 1e-6) + int(0.2 * n + 1e-6) - 1]]
    assert fine.assign(df).where("k = 5000").first()["split"] is None


def test_copies_of_an_id_end_the_rounds(spark):
    df = spark.range(300).select(F.lit(7).alias("k"), F.lit(1).alias("y"))
    fit = fit_split(df, "k", "y", cell_bits=8, cell_rows=10)
    assert fit.cuts[1][0] == fit.cuts[1][1] and fit.cuts[1][0][1] == 7


def test_splits_are_disjoint(spark):
    df = labelled(spark, 500, 5)
    out = fit_split(df, "k", "y").assign(df)
    checks.require_disjoint(out, "k")
    with pytest.raises(ValueError):
        checks.require_disjoint(out.unionByName(out.limit(5).withColumn("split", F.lit("other"))), "k")


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, None)], "k int, y int")
    with pytest.raises(ValueError):
        checks.require_unique(df, "k")
    with pytest.raises(ValueError):
        checks.require_target(df, "y")
    wide = spark.createDataFrame([(1.0, float("nan")), (2.0, 3.0)], "a double, b double")
    with pytest.raises(ValueError):
        checks.require_finite(wide, ["a", "b"])
    checks.require_finite(wide, ["a"])


@pytest.mark.parametrize("n0,n1,rate", [(900, 100, 0.1), (900, 50, 0.1), (7, 2, 0.5), (9, 4, 0.2), (569877 * 6 // 10, 12397, 0.3)])
def test_synthetic_count(spark, n0, n1, rate):
    got = spark.range(1).select(synthetic_count(F.lit(n0), F.lit(n1), F.lit(rate))).first()[0]
    assert got == max(0, int(round(n0 / (1.0 - rate) - (n0 + n1))))
