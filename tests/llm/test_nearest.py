import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespark.llm.nearest import axis_order, nearest_vectors, rotated

SCHEMA = "vec_id bigint, embedding array<float>, h1 int, v int, b int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3) for i, v in rows], SCHEMA)


def every(n):
    return lambda i: F.pmod(i, F.lit(n)) == 0


def brute(rows, n, k=5):
    """{query: [(id, score)]} over usable rows of one dimension."""
    rows = [(i, np.asarray(v, np.float32).astype(float)) for i, v in dict(rows).items()]
    out = {}
    for i, v in rows:
        if i % n == 0:
            near = [(-(v @ w) / np.sqrt(v @ v) / np.sqrt(w @ w), j) for j, w in rows if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in near)[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_rotation_keeps_lengths_and_codes_are_nearest_axes():
    x = np.random.default_rng(0).normal(size=(50, 24))
    y = rotated(x, 1)
    assert y.shape == (50, 32) and np.allclose((y**2).sum(1), (x**2).sum(1))
    assert np.allclose(y @ y.T, x @ x.T)
    axes = np.concatenate([np.eye(32), -np.eye(32)])
    assert (axis_order(y, 3) == np.argsort(-(y @ axes.T), 1)[:, :3]).all()


@pytest.mark.parametrize("group_rows", [16384, 8])
def test_recall_without_structure(spark, group_rows):
    """The hardest case: vectors in no groups at all; small groups force second codes and blocks."""
    x = np.random.default_rng(1).normal(size=(1500, 64))
    rows = list(enumerate(x.tolist()))
    got, want = answers(nearest_vectors(frame(spark, rows), every(10), group_rows=group_rows)), brute(rows, 10)
    assert set(got) == set(want) and all(len(near) == 5 for near in got.values())
    assert recall(got, want) >= 0.9
    exact = {(q, j): s for q, near in brute(rows, 10, 1500).items() for j, s in near}
    assert all(abs(exact[q, j] - s) < 1e-9 for q, near in got.items() for j, s in near)


def test_a_query_far_from_all_finds_them(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [-1.0] + [0.0] * 63)] + [(i, [1.0, *(1e-3 * rng.normal(size=63))]) for i in range(1, 300)]
    got = answers(nearest_vectors(frame(spark, rows), lambda i: i == 0, group_rows=50))
    assert [j for j, _ in got[0]] == [j for j, _ in brute(rows, 10_000)[0]]


def test_copies_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(i, base.tolist()) for i in range(300)]  # a third are one vector
    rows += [(300 + i, (base + 1e-3 * rng.normal(size=64)).tolist()) for i in range(100)]
    rows += [(400 + i, rng.normal(size=64).tolist()) for i in range(500)]
    got = answers(nearest_vectors(frame(spark, rows * 2).repartition(7), every(50), group_rows=20))
    for q in range(0, 300, 50):
        assert [j for j, _ in got[q]] == [j for j in range(6) if j != q][:5] and all(abs(s - 1) < 1e-12 for _, s in got[q])
    want = brute(rows, 50)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_odd_rows(spark):
    rows = [
        (0, [1, 0, 0]), (1, [2, 0, 0]), (2, None), (3, [0, 0, 0]), (4, [1, None, 0]), (5, [1, float("nan"), 0]), (6, [1, float("inf"), 0]), (7, []),
        (None, [1, 0, 0]), (50, [0, 1, 1]), (-50, [0, 1, 1]), (8, [1, 1]), (100, [3]), (9, [-2]), (150, [1, 2, 3, 4, 5]), (10, [1e-30, 0, 0]),
    ]
    got = answers(nearest_vectors(frame(spark, rows + rows[:4]), every(50)))
    assert [j for j, s in got[0] if s > 0.5] == [1, 10] and got[50][0][0] == -50 and got[-50][0][0] == 50
    assert got[100] == [(9, -1.0)] and {j for j, _ in got[0]} == {1, 10, 50, -50}
    assert 150 not in got and not {2, 3, 4, 5, 6, 7, 8} & {j for near in got.values() for j, _ in near}
    assert nearest_vectors(frame(spark, rows).where("vec_id = 77"), every(50)).count() == 0
