import numpy as np
import pytest

from rarespark.operators import neighbor_graph
from rarespark.operators.neighbor_graph import approximate_neighbors
from tests.test_neighbors import brute, frame


def found(spark, x, **options):
    rows = approximate_neighbors(frame(spark, x), 5, **options).collect()
    return {r["id"]: [(n["id"], n["d2"]) for n in r["neighbors"]] for r in rows}


def recall(got, want):
    assert sorted(got) == list(range(len(want)))
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in enumerate(want))
    return hits / sum(map(len, want))


def test_recall_without_structure(spark):
    x = np.random.default_rng(5).normal(size=(700, 16))
    got, want = found(spark, x, block_rows=60), brute(x, 5)
    assert recall(got, want) >= 0.9
    for i, near in got.items():
        assert len(near) == 5 == len({j for j, _ in near}) and i not in {j for j, _ in near}
        assert [d for _, d in near] == pytest.approx([((x[i] - x[j]) ** 2).sum() for j, _ in near], abs=1e-8)
        assert near == sorted(near, key=lambda p: (p[1], p[0]))


def test_rounds_raise_the_recall(spark):
    x = np.random.default_rng(6).normal(size=(500, 16))
    want = brute(x, 5)
    first = recall(found(spark, x, block_rows=40, rounds=0), want)
    assert first < 0.9 <= recall(found(spark, x, block_rows=40), want)


def test_one_block_is_exact_and_a_third_are_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    x[rng.permutation(300)[:100]] = [0.5, -0.0, 1.0]
    x[:4] = x[10]
    want = [[j for j, _ in w] for w in brute(x, 5)]
    got = found(spark, x)
    assert [[j for j, _ in got[i]] for i in range(300)] == want
    # copies are found whatever the graph is
    few = found(spark, x, block_rows=40)
    same = [i for i in range(300) if sum((x == x[i]).all(1)) > 5]
    assert all([j for j, _ in few[i]] == want[i] for i in same) and len(same) >= 98


def test_no_rows_one_row_and_repeatable(spark):
    none = spark.createDataFrame([], "id bigint, features array<double>")
    assert approximate_neighbors(none).count() == 0
    assert [r["neighbors"] for r in approximate_neighbors(frame(spark, [[1.0, 2.0]])).collect()] == [[]]
    x = np.random.default_rng(8).normal(size=(200, 8))
    once = found(spark, x, block_rows=50, rounds=2)
    again = approximate_neighbors(frame(spark, x).repartition(3), 5, block_rows=50, rounds=2).collect()
    assert once == {r["id"]: [(n["id"], n["d2"]) for n in r["neighbors"]] for r in again}


def test_groups_that_go_on_in_the_next_batch(spark):
    x = np.random.default_rng(9).normal(size=(150, 8))
    whole = found(spark, x, block_rows=40, rounds=2)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, x, block_rows=40, rounds=2) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_vector_moves_once_to_a_group(spark, monkeypatch):
    x = np.random.default_rng(10).normal(size=(300, 8)).astype(np.float32).astype(float)
    moved, join = [], neighbor_graph.salted_join

    def counted(left, *more):
        if "group" in left.columns:
            moved.append((left.count(), left.select("member", "group").distinct().count()))
        return join(left, *more)

    monkeypatch.setattr(neighbor_graph, "salted_join", counted)
    got = found(spark, x, block_rows=40, rounds=4)
    assert all(rows == distinct <= neighbor_graph.GROUPS * 300 for rows, distinct in moved) and len(moved) == 4
    # as many groups as need be
    monkeypatch.setattr(neighbor_graph, "GROUP_BYTES", 1 << 16)
    monkeypatch.setattr(neighbor_graph, "_PAIRS_HELD", 50)
    assert found(spark, x, block_rows=40, rounds=4) == got


def test_not_used_by_default():
    import rarespark.operators.oversample as oversample

    assert oversample.nearest_neighbors.__module__ != neighbor_graph.__name__
