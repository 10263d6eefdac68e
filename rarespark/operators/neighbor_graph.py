"""Approximate k nearest neighbours by refining a neighbour graph with joins.

A labelled option for many minority rows without cluster structure, where the exact search
(``operators/neighbors.py``, the default everywhere) has to compare nearly all pairs.

1. Distinct vectors are placed around sampled pivots, ``tables`` times with other pivots; each finds
   its ``width`` nearest within its own block. That is the first graph.
2. In each round every vector, as a hub, gathers its neighbours and up to ``width`` of the vectors that list it, and
   they are compared with each other. A pair is passed on only to the side whose list it improves.
3. Rounds end when less than ``settled`` of the entries changed, or after ``rounds``.

Hubs are dealt to groups, ``GROUPS`` or so many that the vectors of one fit ``GROUP_BYTES``. A vector moves once to each group
with hubs of its own, and a group passes on the ``width`` best entries of a list. So a vector moves at most ``GROUPS`` times a round while groups
are few, ``2 * width + 1`` times on average however many there are, and the work grows in proportion to the vectors. Vectors of 32-bit numbers
move as such.
Distances are exact, neighbours may be missed. Ties go to the smaller id. Results don't depend on
partitioning: all draws are made of keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.draws import draw_bits
from rarespark.operators.joins import heavy_keys, salted_join
from rarespark.operators.neighbors import (
    DECIMALS, MAX_BLOCKS, _as_list, _assign_cells, _cut_blocks, _search_own_block, distinct_vectors, keyed_points, lists_of_rows,
)
from rarespark.session import materialize
from rarespark.settings import K_NEIGHBORS, SEED

WIDTH, TABLES, ROUNDS, SETTLED = 24, 2, 12, 0.001
BLOCK_ROWS, MAX_PIVOTS = 512, 4096
GROUPS, GROUP_BYTES = 12, 512 << 20
_PAIRS_HELD = 1 << 20
_LIST = "array<struct<d2: double, id: bigint>>"


def approximate_neighbors(
    points: DataFrame,
    k: int = K_NEIGHBORS,
    id: str = "id",
    vector: str = "features",
    seed: int = SEED,
    width: int = WIDTH,
    tables: int = TABLES,
    rounds: int = ROUNDS,
    settled: float = SETTLED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows ``(id, neighbors)`` as ``nearest_neighbors`` gives them, of which some may not be the nearest.

    ``width`` is the length of the lists while they are refined: recall rises with it, work with its square.
    """
    pts = keyed_points(points, id, vector)
    want = k + 1
    width = max(width, want)
    reps = materialize(distinct_vectors(pts, want), "vectors")
    narrow = F.min(F.forall("vec", lambda v: v.cast("float").cast("double") == v)).alias("narrow")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("ids")).alias("most"), narrow, F.max(F.size("vec")).alias("long")).first()
    if not size["n"]:
        return pts.select("id", F.array().cast(_LIST).alias("neighbors"))
    block_rows = max(block_rows, math.ceil(size["n"] / MAX_BLOCKS))
    nodes = reps.select("rep", "vkey", "vec", F.array("rep").alias("ids"))
    starts = [_block_lists(nodes, size["n"], width, block_rows, f"{seed}:{t}") for t in range(tables if size["n"] > block_rows else 1)]
    number = "float" if size["narrow"] else "double"  # no number is changed
    row_bytes = (4 if size["narrow"] else 8) * size["long"] + 8 * width + 64
    groups = max(GROUPS, math.ceil(size["n"] * (2 * width + 1) * row_bytes / GROUP_BYTES))
    graph = nodes.select("rep", F.col("vec").cast(f"array<{number}>").alias("vec"), F.array().cast(_LIST).alias("nearest"))
    graph, _ = _improved(graph, starts, width)
    for turn in range(rounds if size["n"] > block_rows else 0):
        graph, changed = _improved(graph, [_closer_pairs(graph, width, f"{seed}:{turn}", groups)], width)
        if changed <= settled * width * size["n"]:
            break
    return lists_of_rows(_with_copies(graph, reps, want), reps, pts, size["most"], k)


def _block_lists(nodes: DataFrame, n: int, width: int, block_rows: int, seed: str) -> DataFrame:
    """``(rep, found)``: the nearest of each vector within its block around one of the drawn pivots."""
    n_pivots = 1 if n <= block_rows else min(MAX_PIVOTS, math.ceil(2 * n / block_rows))
    sample = nodes.orderBy(draw_bits(seed, "pivot", F.col("rep")), "rep").limit(n_pivots).select("vec").collect()
    cells = materialize(_assign_cells(nodes, np.array([r["vec"] for r in sample], dtype=np.float64)), "cells")
    shape = {r["cell"]: (r["n"], r["near"], r["far"]) for r in cells.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")).collect()}
    blocks, _ = _cut_blocks(cells, shape, block_rows)
    # the vector itself is among its nearest
    lists = _search_own_block(blocks, width + 1).select("rep", _as_list(F.col("d2s"), F.col("ids")).alias("found"))
    return lists.select("rep", F.filter("found", lambda p: p["id"] != F.col("rep")).cast(_LIST).alias("found"))


def _improved(graph: DataFrame, found: list[DataFrame], width: int) -> tuple[DataFrame, int]:
    """The graph with the ``width`` best of its own and the found entries, and the number of entries that changed."""
    rows = graph.select("rep", "vec", "nearest", F.col("nearest").alias("found"))
    for more in found:
        rows = rows.unionByName(more.select("rep", "found"), allowMissingColumns=True)
    merged = rows.groupBy("rep").agg(
        F.first("vec", True).alias("vec"), F.first("nearest", True).alias("old"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, width).alias("nearest"),
    )
    new = F.size(F.array_except("nearest", "old")).alias("changed")
    stored = materialize(merged.select("rep", "vec", "nearest", new), "graph")
    return stored.drop("changed"), stored.agg(F.sum("changed")).first()[0] or 0


def _closer_pairs(graph: DataFrame, width: int, seed: str, groups: int) -> DataFrame:
    """``(rep, found)``: entries that improve the list of ``rep``, seen around a common neighbour; a row for each group that has any."""
    listed = graph.select("rep", F.explode("nearest.id").alias("id"))
    draw = Window.partitionBy("id").orderBy(draw_bits(seed, "back", F.concat_ws(":", "rep", "id")), "rep")
    back = listed.withColumn("_rn", F.row_number().over(draw)).where(F.col("_rn") <= width)
    own = graph.select(F.col("rep").alias("hub"), F.col("rep").alias("member"))
    pairs = listed.select(F.col("rep").alias("hub"), F.col("id").alias("member"))
    pairs = pairs.union(back.select(F.col("id").alias("hub"), F.col("rep").alias("member"))).union(own)
    group = F.pmod(F.xxhash64("hub"), F.lit(groups)).alias("group")
    visits = materialize(pairs.groupBy(group, "member").agg(F.collect_set("hub").alias("hubs")), "around")
    last = F.when(F.size("nearest") >= width, F.get("nearest", width - 1)["d2"]).otherwise(F.lit(float("inf"))).alias("worst")
    members = graph.select(F.col("rep").alias("member"), "vec", last, F.col("nearest.id").alias("known"))
    placed = salted_join(visits, members, ["member"], heavy_keys(visits, "member"), "member", F.col("group"))
    placed = placed.select("group", "member", "hubs", "worst", "known", "vec").repartition("group").sortWithinPartitions("group", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group may go on in the next batch
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(starts[:-1], starts[1:]):
                if rest and rest[-1].column(0)[0].as_py() != numbers[a]:
                    yield _group_entries(rest, width)
                    rest = []
                rest.append(batch.slice(a, b - a))
        if rest:
            yield _group_entries(rest, width)

    return placed.mapInArrow(compare, f"rep bigint, found {_LIST}")


def _group_entries(batches: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    """``(rep, found)`` of the vectors of a group, of which those with a common hub are compared."""
    table = pa.Table.from_batches(batches)
    ids, worst = (table.column(c).to_numpy() for c in ("member", "worst"))
    hubs, hub_counts = _flat(table.column("hubs"))
    near, near_counts = _flat(table.column("known"))
    x = _flat(table.column("vec"))[0].reshape(len(ids), -1)
    known = np.repeat(ids[:, None], width + 1, 1)  # the row itself is never its neighbour
    known[:, 1:][np.arange(width) < near_counts[:, None]] = near
    order = np.argsort(hubs, kind="stable")
    rows = np.repeat(np.arange(len(ids)), hub_counts)[order]
    cuts = np.flatnonzero(np.diff(hubs[order])) + 1
    best, held, size = [np.empty(0, np.int64)] * 2 + [np.empty(0)], [], 0
    for own in np.split(rows, cuts):
        own_ids, vectors = ids[own], x[own].astype(np.float64)
        delta = vectors[:, None, :] - vectors[None, :, :]
        d2 = np.round(np.einsum("ijk,ijk->ij", delta, delta), DECIMALS)
        better = (d2 < worst[own][:, None]) & ~(known[own][:, None, :] == own_ids[None, :, None]).any(2)
        i, j = np.nonzero(better)
        held.append([own_ids[i], own_ids[j], d2[i, j]])
        size += len(i)
        if size > max(_PAIRS_HELD, len(best[0])):
            best, held, size = _best_entries([best, *held], width), [], 0
    rep, other, d2 = _best_entries([best, *held], width)
    begins = np.flatnonzero(np.append(True, rep[1:] != rep[:-1])) if len(rep) else np.empty(0, np.int64)
    entries = pa.StructArray.from_arrays([pa.array(d2, pa.float64()), pa.array(other, pa.int64())], ["d2", "id"])
    offsets = pa.array(np.append(begins, len(rep)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(rep[begins], pa.int64()), pa.ListArray.from_arrays(offsets, entries)], ["rep", "found"])


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists, one after the other, and the length of each."""
    values = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in lists.chunks]
    return np.concatenate(values), np.concatenate([chunk.value_lengths().to_numpy(zero_copy_only=False) for chunk in lists.chunks])


def _best_entries(parts: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """The ``width`` nearest distinct entries ``(rep, id, d2)`` of each ``rep``, in order."""
    rep, other, d2 = (np.concatenate([p[c] for p in parts]) for c in range(3))
    order = np.lexsort((other, d2, rep))
    rep, other, d2 = rep[order], other[order], d2[order]
    new = np.ones(len(rep), bool)
    new[1:] = (rep[1:] != rep[:-1]) | (other[1:] != other[:-1]) | (d2[1:] != d2[:-1])
    rep, other, d2 = rep[new], other[new], d2[new]
    begins = np.flatnonzero(np.append(True, rep[1:] != rep[:-1])) if len(rep) else np.empty(0, np.int64)
    place = np.arange(len(rep)) - np.repeat(begins, np.diff(np.append(begins, len(rep))))
    return [c[place < width] for c in (rep, other, d2)]


def _with_copies(graph: DataFrame, reps: DataFrame, want: int) -> DataFrame:
    """``(rep, nearest)`` with the ids of all copies, the vector's own first."""
    flat = graph.select("rep", F.inline(F.slice("nearest", 1, want))).withColumnRenamed("id", "other")
    copies = reps.select(F.col("rep").alias("other"), "ids")
    near = salted_join(flat, copies, ["other"], heavy_keys(flat, "other"), "other", F.col("rep"))
    every = near.select("rep", "d2", "ids").unionByName(reps.select("rep", F.lit(0.0).alias("d2"), "ids"))
    entries = every.select("rep", F.transform("ids", lambda i: F.struct(F.col("d2").alias("d2"), i.alias("id"))).alias("found"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, want)
    return entries.groupBy("rep").agg(best.alias("nearest"))
