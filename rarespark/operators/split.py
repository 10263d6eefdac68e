"""Exact seeded stratified split without sorting or moving the rows.

Within each class rows are ordered by a seeded hash of their id. A split needs
only the two cut points of that order, so they are found by counting: a
histogram of the leading hash bits finds the cell each cut lies in. Cells of more
than ``CELL_ROWS`` rows are counted again by their next bits, and so on; then
the rows of these few cells are ranked. A round reads ids and targets, moves a few thousand
counts, and makes cells 4096 times smaller: two rounds are enough for 10^12 rows. Assigning the split
is then a comparison with literals in the scan itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.draws import DRAW_BITS, draw_bits
from rarespark.settings import SEED, TRAIN_SHARE, VALID_SHARE

SPLITS = ("train", "validation", "test")
CELL_BITS = 12
CELL_ROWS = 100_000


def _floor_share(share: float, n: int) -> int:
    # 0.6 * n in binary may fall just below a whole number
    return math.floor(round(share * n, 6))


@dataclass(frozen=True)
class StratifiedSplit:
    key: str
    target: str
    seed: int
    # class -> [(hash, id) of the last train row, of the last validation row]; None = no such row
    cuts: dict[int, list[tuple[int, object] | None]]

    def assign(self, df: DataFrame, out: str = "split") -> DataFrame:
        """Add the split name; a narrow projection."""
        h = draw_bits(self.seed, "split", F.col(self.key))

        def up_to(cut) -> Column:
            if cut is None:
                return F.lit(False)
            return (h < cut[0]) | ((h == cut[0]) & (F.col(self.key) <= F.lit(cut[1])))

        name = F.lit(None).cast("string")
        for label, (train_cut, valid_cut) in self.cuts.items():
            part = F.when(up_to(train_cut), SPLITS[0]).when(up_to(valid_cut), SPLITS[1]).otherwise(SPLITS[2])
            name = F.when(F.col(self.target) == label, part).otherwise(name)
        return df.withColumn(out, name)


@dataclass(frozen=True)
class _Cut:
    """The row of rank ``rank`` (from 1) among those of a class whose hash, without its last ``left`` bits, is ``cell``."""

    label: int
    which: int
    rank: int
    cell: int
    left: int

    def holds(self) -> Column:
        return (F.col("y") == self.label) & (F.shiftright("h", self.left) == self.cell)


def _cell_counts(hashed: DataFrame, left: int) -> dict[int, list[tuple[int, int]]]:
    """class -> [(cell, rows)], ascending. Bounded: the rows given lie in few cells of the round before."""
    found: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(hashed.groupBy("y", F.shiftright("h", left).alias("cell")).agg(F.count("*").alias("n")).collect()):
        found.setdefault(r["y"], []).append((r["cell"], r["n"]))
    return found


def _inner(cut: _Cut, cells: list[tuple[int, int]], left: int) -> tuple[_Cut, int]:
    """The same cut in the finer cell it lies in, and the rows of that cell."""
    rank = cut.rank
    for cell, n in cells:
        if cell >> (cut.left - left) != cut.cell:
            continue
        if rank <= n:
            return _Cut(cut.label, cut.which, rank, cell, left), n
        rank -= n
    raise ValueError("the rows changed between two passes")


def fit_split(
    df: DataFrame,
    key: str,
    target: str,
    seed: int = SEED,
    train_share: float = TRAIN_SHARE,
    valid_share: float = VALID_SHARE,
    cell_bits: int = CELL_BITS,
    cell_rows: int = CELL_ROWS,
) -> StratifiedSplit:
    """Find the cut points. Reads only ``key`` and ``target``; moves counts, and at most ``cell_rows``
    rows for each cut (more only where so many ids share all bits of their hashes). Rows without target are in no split."""
    hashed = df.select(
        F.col(target).cast("int").alias("y"), F.col(key).alias("id"), draw_bits(seed, "split", F.col(key)).alias("h")
    ).where("y IS NOT NULL")
    left = DRAW_BITS - cell_bits
    counts = _cell_counts(hashed, left)
    cuts: dict[int, list] = {label: [None, None] for label in counts}
    wide, small = [], []
    for label, cells in counts.items():
        size = sum(n for _, n in cells)
        n_train = _floor_share(train_share, size)
        for which, rank in enumerate((n_train, n_train + _floor_share(valid_share, size))):
            if rank:
                wide.append(_Cut(label, which, rank, 0, DRAW_BITS))
    while wide:
        finer = [_inner(cut, counts[cut.label], left) for cut in wide]
        wide = [cut for cut, n in finer if n > cell_rows and left]
        small += [cut for cut, n in finer if n <= cell_rows or not left]
        if wide:
            left = max(0, left - cell_bits)
            counts = _cell_counts(hashed.where(reduce(or_, [cut.holds() for cut in wide])), left)
    if small:
        # cuts of one class may share a cell, other cells are disjoint
        places = list(dict.fromkeys((cut.label, cut.cell, cut.left) for cut in small))
        place = F.coalesce(*[F.when(_Cut(label, 0, 0, cell, bits).holds(), i) for i, (label, cell, bits) in enumerate(places)])
        ranks = [(places.index((cut.label, cut.cell, cut.left)), cut.rank) for cut in small]
        picked = reduce(or_, [(F.col("place") == i) & (F.col("rank") == rank) for i, rank in ranks])
        rows = hashed.where(reduce(or_, [cut.holds() for cut in small])).withColumn("place", place)
        order = Window.partitionBy("place").orderBy("h", "id")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(picked).collect()  # a row a cut
        found = {(r["place"], r["rank"]): (r["h"], r["id"]) for r in rows}
        for cut, at in zip(small, ranks):
            cuts[cut.label][cut.which] = found[at]
    return StratifiedSplit(key, target, seed, cuts)


def split_summary(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows, positives and positive rate of each split."""
    y = F.col(target).cast("bigint")
    return df.groupBy(split).agg(
        F.count("*").alias("rows"), F.sum(y).alias("fraud_count"), F.avg(y).alias("fraud_rate")
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """One row: negatives ``n0``, positives ``n1`` and the positive weight ``n0 / max(n1, 1)``."""
    y = F.col(target).cast("bigint")
    counts = df.agg(
        F.coalesce(F.sum(1 - y), F.lit(0)).alias("n0"), F.coalesce(F.sum(y), F.lit(0)).alias("n1")
    )
    return counts.withColumn("pos_weight", F.col("n0") / F.greatest(F.col("n1"), F.lit(1)))


def synthetic_count(n0: Column, n1: Column, rate: Column) -> Column:
    """Positives to add so that they make up ``rate`` of all rows (half-even, not below 0)."""
    wanted = n0.cast("double") / (1.0 - rate) - (n0 + n1).cast("double")
    return F.greatest(F.lit(0).cast("bigint"), F.rint(wanted).cast("bigint"))


def positive_rate(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.avg(F.col(target).cast("bigint")).alias("fraud_rate"))
