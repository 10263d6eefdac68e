"""Approximate nearest neighbours by cosine, with cross-polytope hashing.

A table turns vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and files each under its nearest signed axis: twice as many codes as
dimensions. A query looks into the codes of its ``PROBE_SHARE`` nearest signed axes in each
of ``TABLES`` tables, and all vectors filed there are compared with it exactly, in double precision.

* Equal vectors are searched once. Of their ids the ``k + 1`` smallest stay, which is all that can
  be among the ``k`` nearest; a group limit keeps as many in each task before the shuffle.
* Codes that hold more than ``GROUP_ROWS`` vectors are divided by a second cross-polytope in as
  few of its dimensions as bring them below it, and queries probe ``SECOND_SHARE`` of the
  second codes. What is still larger is cut into blocks, which every query of the code
  visits. So no group is larger than planned, and none is left out.
* A query that finds fewer than ``k`` others visits every place of one table, which is exact.

Recall of the five nearest (measured against brute force on the given tables, whose vectors have no
structure, the hardest case) is in the README and in the tests.

Vectors that are null, empty, zero or hold a null or non-finite component, and rows without an id,
take no part. Only vectors of one dimension are compared. Repeated rows count once; an id with several
vectors has an answer for each, and stands for a candidate of its nearest one.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarespark.operators.joins import heavy_keys, salted_join
from rarespark.session import materialize

NEAREST = 5
TABLES = 4
PROBE_SHARE, SECOND_SHARE = 0.1875, 0.75
GROUP_ROWS = 16384
_QUERIES = 256
_SLACK = 1e-9


@lru_cache(64)
def _signs(table: int, level: int, width: int) -> np.ndarray:
    return np.random.RandomState([table, level, width]).choice([-1.0, 1.0], (3, width))


def rotated(x: np.ndarray, table: int, level: int = 0) -> np.ndarray:
    """Pseudo-rotation of the rows, padded to a power of two."""
    n, d = x.shape
    width = 1 << (d - 1).bit_length()
    y = np.zeros((n, width))
    y[:, :d] = x
    for signs in _signs(table, level, width):
        y = y * signs
        half = 1
        while half < width:
            pairs = y.reshape(n, width // (2 * half), 2, half)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
            half *= 2
        y = y / math.sqrt(width)
    return y


def axis_order(y: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, the nearest first."""
    both = np.concatenate([y, -y], 1)
    probes = min(probes, both.shape[1])
    if probes == 1:
        return both.argmax(1)[:, None]
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _by_dimension(column: pa.Array):
    """(rows, matrix) for each length of the lists of a batch."""
    lengths = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)]


def usable_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _second_codes(y: np.ndarray, fan: int, probes: int) -> np.ndarray:
    return axis_order(y[:, : fan // 2], probes)


class _Plan:
    """How the codes of each dimension and table are divided: a table of bounded size."""

    def __init__(self):
        self.fan: dict[tuple, int] = {}
        self.blocks: dict[tuple, int] = {}

    def members(self, x: np.ndarray, spread: np.ndarray, tables: int = TABLES):
        """For each table ``(codes, second codes, blocks)``."""
        d = x.shape[1]
        for table in range(tables):
            first = axis_order(rotated(x, table), 1)[:, 0]
            second, fans = np.zeros(len(x), np.int64), np.array([self.fan.get((d, table, c), 1) for c in first.tolist()])
            if (fans > 1).any():
                y = rotated(x, table, 1)
                for fan in np.unique(fans[fans > 1]):
                    rows = np.flatnonzero(fans == fan)
                    second[rows] = _second_codes(y[rows], fan, 1)[:, 0]
            blocks = np.array([self.blocks.get((d, table, c, s), 1) for c, s in zip(first.tolist(), second.tolist())])
            yield table, first, second, spread % blocks

    def probes(self, x: np.ndarray, tables: int = TABLES, share: float = PROBE_SHARE, second_share: float = SECOND_SHARE):
        """``(row, table, code, second code, block)`` of every place that a query visits."""
        d = x.shape[1]
        probes = math.ceil(share * 2 * (1 << (d - 1).bit_length()))
        for table in range(tables):
            near = axis_order(rotated(x, table), probes)
            y = rotated(x, table, 1) if any(k[:2] == (d, table) for k in self.fan) else None
            seconds: dict[int, np.ndarray] = {}
            for row, codes in enumerate(near.tolist()):
                for code in codes:
                    fan = self.fan.get((d, table, code), 1)
                    if fan > 1 and fan not in seconds:
                        seconds[fan] = _second_codes(y, fan, math.ceil(second_share * fan))
                    for second in seconds[fan][row].tolist() if fan > 1 else (0,):
                        for block in range(self.blocks.get((d, table, code, second), 1)):
                            yield row, table, code, second, block


def _count_codes(points: DataFrame, plan: _Plan, second: bool) -> list:
    """Sizes of the codes, at most ``2 d`` (squared with ``second``) for each table and dimension; combined in the tasks."""
    shared = points.sparkSession.sparkContext.broadcast(plan)

    def count(batches):
        sizes: dict[tuple, int] = {}
        for batch in batches:
            for _, x in _by_dimension(batch.column(0)):
                for table, first, then, _ in shared.value.members(_unit(x), np.zeros(len(x), np.int64)):
                    keys = zip(first.tolist(), then.tolist())
                    for code, other in keys:
                        key = (x.shape[1], table, code, other)
                        sizes[key] = sizes.get(key, 0) + 1
        if sizes:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in zip(*sizes)), pa.array(list(sizes.values()), pa.int64())], ["d", "t", "c", "s", "n"]
            )

    counted = points.select("v").mapInArrow(count, "d bigint, t bigint, c bigint, s bigint, n bigint")
    return counted.groupBy("d", "t", "c", *(["s"] if second else [])).agg(F.sum("n").alias("n")).where(F.col("n") > 0).collect()


def _planned(points: DataFrame, group_rows: int) -> _Plan:
    plan = _Plan()
    for row in _count_codes(points, plan, False):
        fan = 1 << max(0, math.ceil(math.log2(row["n"] / group_rows)))
        if fan > 1:
            plan.fan[(row["d"], row["t"], row["c"])] = min(fan, 2 * (1 << (row["d"] - 1).bit_length()))
    if plan.fan:
        for row in _count_codes(points, plan, True):
            blocks = -(-row["n"] // group_rows)
            if blocks > 1:
                plan.blocks[(row["d"], row["t"], row["c"], row["s"])] = blocks
    return plan


_PLACES = ["d", "t", "c", "s", "b", "asks"]


def _placed(points: DataFrame, plan: _Plan, everywhere: bool = False) -> DataFrame:
    """Every vector once for each table, and once more for each place it has to visit as a query; ``everywhere``: in
    one table, all of whose places are visited."""
    tables, shares = (1, (1.0, 1.0)) if everywhere else (TABLES, (PROBE_SHARE, SECOND_SHARE))
    shared = points.sparkSession.sparkContext.broadcast(plan)
    names = [*_PLACES, "h1", "h2", "ids", "v"]

    def place(batches):
        for batch in batches:
            asks = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            spread = np.abs(batch.column(0).to_numpy() >> 8)
            for rows, x in _by_dimension(batch.column(3)):
                unit, d = _unit(x), x.shape[1]
                found = [np.stack([rows, np.full(len(rows), t), c, s, b, np.zeros(len(rows), np.int64)], 1) for t, c, s, b in shared.value.members(unit, spread[rows], tables)]
                asking = np.flatnonzero(asks[rows])
                visits = np.array(list(shared.value.probes(unit[asking], tables, *shares)), np.int64).reshape(-1, 5)
                found.append(np.concatenate([rows[asking[visits[:, 0]]][:, None], visits[:, 1:], np.ones((len(visits), 1), np.int64)], 1))
                at = np.concatenate(found)
                for start in range(0, len(at), 8192):
                    piece = at[start : start + 8192]
                    own = batch.select([0, 1, 2, 3]).take(pa.array(piece[:, 0]))
                    columns = [pa.array(np.full(len(piece), d), pa.int64()), *(pa.array(np.ascontiguousarray(piece[:, i])) for i in range(1, 6))]
                    yield pa.RecordBatch.from_arrays([*columns, *own.columns], names)

    schema = "d bigint, t bigint, c bigint, s bigint, b bigint, asks bigint, h1 bigint, h2 bigint, ids array<bigint>, v array<double>"
    return points.select("h1", "h2", "ids", "v", "asks").mapInArrow(place, schema)


def _compare(ids: list, x: np.ndarray, queries: np.ndarray, k: int):
    """``(query, id, score)`` of the ``k`` nearest ids of the group for each query."""
    unit = _unit(x)
    for start in range(0, len(queries), _QUERIES):
        some = queries[start : start + _QUERIES]
        near = _unit(some) @ unit.T
        if near.shape[1] > k:
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            q, m = np.nonzero(near >= least[:, None] - _SLACK)
        else:
            q, m = (i.ravel() for i in np.indices(near.shape))
        score = cosines(some[q], x[m])
        own: dict[int, list] = {}
        for i, member, s in zip(q.tolist(), m.tolist(), score.tolist()):
            own.setdefault(i, []).extend((-s, other) for other in ids[member])
        for i, found in own.items():
            for s, other in sorted(found)[:k]:
                yield start + i, other, -s


def _searched(placed: DataFrame, k: int) -> DataFrame:
    """``(h1, h2, id, score)``: for each query vector the nearest of every place it visits."""

    def search(batches):
        ids, x, group = [], None, None

        def rows():
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy() for i in range(6)], 1)
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                    yield tuple(keys[a].tolist()), batch.slice(a, b - a)

        for key, parts in groupby(rows(), key=lambda r: r[0]):
            if not key[5]:
                group, ids, stacked = key[:5], [], []
                for _, part in parts:
                    ids += part.column(8).to_pylist()
                    stacked.append(part.column(9).flatten().to_numpy().reshape(-1, key[0]))
                x = np.concatenate(stacked)
                continue
            if group != key[:5]:
                continue  # no vector is filed here
            for _, part in parts:
                found = list(_compare(ids, x, part.column(9).flatten().to_numpy().reshape(-1, key[0]), k))
                q, other, score = zip(*found)
                own = part.select([6, 7]).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(other, pa.int64()), pa.array(score, pa.float64())], ["h1", "h2", "id", "score"])

    group = _PLACES[:5]
    return placed.repartition(*group).sortWithinPartitions(*_PLACES).mapInArrow(search, "h1 bigint, h2 bigint, id bigint, score double")


def _nearest_lists(found: DataFrame, k: int) -> DataFrame:
    """``(h1, h2, near)``: the ``k`` best of what was found in all places, each id once."""
    best = found.groupBy("h1", "h2", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    best = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("_n", "id", "score"))).alias("near"))


def nearest_vectors(
    vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding", k: int = NEAREST, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row whose id fits ``is_query``, a
    function from the id's column to a condition. A row with the query's own id is no candidate."""
    rows = usable_vectors(vectors, key, column)
    rows = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))
    keys = materialize(rows.select("id", "h1", "h2").distinct(), "vector-keys")
    queries = keys.where(is_query(F.col("id"))).withColumnRenamed("id", "query_id")
    order = Window.partitionBy("h1", "h2").orderBy("id")
    few = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = queries.select("h1", "h2").distinct().withColumn("asks", F.lit(True))
    # a vector moves once, whatever the number of its copies
    points = rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(ids, ["h1", "h2"]).join(asked, ["h1", "h2"], "left")
    points = points.select("h1", "h2", "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
    points = materialize(points, "points")

    plan = _planned(points, group_rows)
    lists = materialize(_nearest_lists(_searched(_placed(points, plan), k + 1), k + 1), "nearest")
    # every query finds itself; one that finds fewer than k more looks everywhere
    short = asked.join(lists.where(F.size("near") > k), ["h1", "h2"], "left_anti")
    if not short.isEmpty():
        again = points.drop("asks").join(short, ["h1", "h2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        whole = _nearest_lists(_searched(_placed(again.select(*points.columns), plan, True), k + 1), k + 1)
        lists = lists.where(F.size("near") > k).unionByName(whole)
    # copies of one vector share its list
    answered = salted_join(queries, lists, ["h1", "h2"], heavy_keys(queries, "h1"), "h1", F.col("query_id"))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    ranked = answered.select("query_id", F.posexplode(others).alias("_p", "_o"))
    return ranked.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_o.id").alias("vec_id"), F.col("_o.score").alias("score"))
