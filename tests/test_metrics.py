import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespark.operators.metrics import (
    best_threshold,
    mark_selected,
    pr_curve,
    ranking_metrics,
    roc_curve,
    threshold_grid,
    threshold_metrics,
    threshold_sweep,
)
from rarespark.operators.ordering import cumulative_counts, dense_index


def brute(y, s):
    ap, auc, recall = 0.0, None, 0.0
    p, n = int(y.sum()), int((1 - y).sum())
    for t in sorted(set(s), reverse=True):
        tp, k = int(y[s >= t].sum()), int((s >= t).sum())
        if p:
            ap += (tp / p - recall) * tp / k
            recall = tp / p
    if p and n:
        pos, neg = s[y == 1], s[y == 0]
        auc = float(((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean())
    return ap, auc


def table(spark, groups, partitions=5):
    rows = [(g, int(a), float(b)) for g, (y, s) in groups.items() for a, b in zip(y, s)]
    return spark.createDataFrame(rows, "scenario string, y int, score double").repartition(partitions)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    y = (rng.random(1500) < 0.1).astype(int)
    return {
        "smooth": (y, rng.random(1500) * 0.5 + 0.3 * y * rng.random(1500)),
        "ties": (y, np.round(rng.random(1500) * 0.3 + 0.2 * y, 1)),
        "piled": (y, np.where(rng.random(1500) < 0.8, 1e-6, rng.random(1500) ** 8)),
        "flat": (y, np.full(1500, 0.25)),
    }


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_ranking_matches_brute_force(spark, groups, ranges):
    got = {r["scenario"]: r for r in ranking_metrics(table(spark, groups), ["scenario"], ranges=ranges).collect()}
    for name, (y, s) in groups.items():
        ap, auc = brute(y, s)
        assert got[name]["average_precision"] == pytest.approx(ap, abs=1e-12)
        assert got[name]["roc_auc"] == pytest.approx(auc, abs=1e-12)


def test_one_group_without_a_name(spark, groups):
    y, s = groups["ties"]
    r = ranking_metrics(table(spark, {"ties": (y, s)}), [], ranges=4).first()
    assert (r["average_precision"], r["roc_auc"]) == pytest.approx(brute(y, s))


def test_monotone_change_leaves_ap_alone(spark, groups):
    df = table(spark, groups)
    a = {r["scenario"]: r["average_precision"] for r in ranking_metrics(df, ["scenario"]).collect()}
    b = {r["scenario"]: r["average_precision"] for r in ranking_metrics(df.withColumn("score", F.exp("score") * 7), ["scenario"]).collect()}
    assert a == pytest.approx(b)


def test_one_class_only(spark):
    df = table(spark, {"none": (np.zeros(4, int), np.array([0.1, 0.2, 0.2, 0.9])), "all": (np.ones(3, int), np.array([0.1, 0.2, 0.3]))})
    got = {r["scenario"]: r for r in ranking_metrics(df, ["scenario"]).collect()}
    assert got["none"]["average_precision"] == 0.0 and got["none"]["roc_auc"] is None
    assert got["all"]["average_precision"] == 1.0 and got["all"]["roc_auc"] is None


def test_cumulative_counts_next_row(spark, groups):
    y, s = groups["ties"]
    rows = cumulative_counts(table(spark, {"ties": (y, s)}), ["scenario"], ranges=6).orderBy(F.desc("score")).collect()
    assert [r["is_top"] for r in rows] == [True] + [False] * (len(rows) - 1)
    for a, b in zip(rows, rows[1:]):
        assert (a["next_pos"], a["next_neg"]) == (b["pos"], b["neg"])
    assert rows[-1]["next_pos"] is None


def test_sweep_matches_brute_force(spark, groups):
    for rounded in (False, True):
        df = table(spark, groups)
        # exact grid values must count as reached
        edge = (np.array([0, 1] * 50)[:99], np.array(threshold_grid(rounded)))
        df = df.unionByName(table(spark, {"edge": edge}))
        got = {(r["scenario"], r["threshold"]): r for r in threshold_sweep(df, ["scenario"], rounded=rounded).collect()}
        for name, (y, s) in {**groups, "edge": edge}.items():
            for t in threshold_grid(rounded):
                hit = s >= t
                tp, k, p = int(y[hit].sum()), int(hit.sum()), int(y.sum())
                r = got[(name, t)]
                assert r["precision"] == pytest.approx(tp / k if k else 0.0)
                assert r["recall"] == pytest.approx(tp / p)
                assert r["f1"] == pytest.approx(2 * tp / (k + p))


def test_best_threshold_prefers_the_lowest(spark):
    y, s = np.array([0, 0, 1, 1]), np.array([0.105, 0.205, 0.505, 0.605])
    sweep = threshold_sweep(table(spark, {"a": (y, s)}), ["scenario"], rounded=True)
    assert best_threshold(sweep, ["scenario"]).first()["threshold"] == 0.21
    assert mark_selected(sweep, ["scenario"]).where("selected").count() == 1


def test_no_prediction_gives_zero(spark):
    df = table(spark, {"a": (np.array([1, 0]), np.array([0.2, 0.1]))})
    thresholds = spark.createDataFrame([("a", 0.9)], "scenario string, threshold double")
    r = threshold_metrics(df, thresholds, ["scenario"]).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_curves_on_a_small_table(spark):
    y, s = np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.35, 0.8])
    df = table(spark, {"a": (y, s)})
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in pr_curve(df, ["scenario"]).collect()}
    assert pr[0.1] == (0.5, 1.0) and pr[0.35] == (pytest.approx(2 / 3), 1.0)
    assert pr[0.4] == (0.5, 0.5) and pr[0.8] == (1.0, 0.5) and pr[None] == (1.0, 0.0)
    roc = [(r["fpr"], r["tpr"]) for r in roc_curve(df, ["scenario"]).orderBy(F.desc_nulls_first("threshold")).collect()]
    assert roc == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("name", ["smooth", "ties", "piled"])
def test_roc_drops_only_collinear_points(spark, groups, name):
    y, s = groups[name]
    thr = np.array(sorted(set(s), reverse=True))
    fps = np.array([int((1 - y)[s >= t].sum()) for t in thr])
    tps = np.array([int(y[s >= t].sum()) for t in thr])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True] if len(thr) > 2 else np.ones(len(thr), bool)
    got = roc_curve(table(spark, {name: (y, s)}), ["scenario"]).where("threshold is not null").collect()
    assert sorted((r["threshold"] for r in got), reverse=True) == list(thr[keep])


@pytest.mark.parametrize("ranges", [1, 7])
def test_dense_index(spark, ranges):
    df = spark.range(0, 900).select((F.col("id") * F.col("id") + 5).alias("k")).repartition(6)
    rows = dense_index(df, "k", ranges=ranges).orderBy("k").collect()
    assert [r["index"] for r in rows] == list(range(900))


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_scores_without_a_place_are_refused(spark, bad):
    from pyspark.sql import functions as F

    from rarespark.operators.metrics import pr_curve, ranking_metrics, roc_curve, threshold_metrics, threshold_sweep

    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.2), ("a", 1, bad)], "scenario string, y int, score double")
    at = spark.createDataFrame([("a", 0.3)], "scenario string, threshold double")
    for make in (ranking_metrics, pr_curve, roc_curve, threshold_sweep, lambda r, by: threshold_metrics(r, at, by)):
        with pytest.raises(Exception, match="NULL or NaN"):
            make(rows, ["scenario"]).collect()
    assert threshold_sweep(rows.where("score < 0.9"), ["scenario"]).where(F.col("threshold") < 0.2).count() == 19
