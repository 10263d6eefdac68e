"""Interleaving sources so that every prefix of the mix has the target weights.

Each source is cut into blocks of about ``BLOCK_CHARS`` characters. In Pfair
scheduling, block k of a source with weight w is released at ``floor(k / w)``, is due at
``ceil((k + 1) / w)``, and the slots go to the released block with the
earliest deadline. No source is ever a whole block ahead or behind. Weights are
whole numbers of ``UNITS``, so the schedule repeats after ``UNITS`` slots: one
period, a table whose size is a parameter, is computed and broadcast, and the slot of
any block follows from it by arithmetic.

The mix ends when every document of every source has been placed once. Sources that
are through by then start over, in further epochs, so nothing is dropped, and blocks go on
over the end of an epoch, so they are full whatever the size of the source.

Sources with a given weight and, without weights, those with ``1 / GROUPS`` of the characters
or more have a stream of their own. All others stand in one stream whose weight is the sum
of theirs, and each keeps its own weight inside it: a document at character ``a`` of a source
with share ``w`` of the pool is due at character ``a / w`` of the pool. Blocks of the pool
hold what is due in them, so at the end of each a source is no more than a document ahead or
behind. A hashed start per source spreads those of few documents. All this is arithmetic
on the row, so there may be any number of sources, and none of them is collected or broadcast.

Null sources are a source of their own, null texts count as empty, rows of
zero length are placed like others, repeated rows are placed each (numbered together); an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarespark.llm.rows import KEY, key_columns, parts_for

BLOCK_CHARS = 1 << 18
UNITS = 10_000
GROUPS = 64
TEMPERATURE = 0.9
CELL_ROWS = 2_000
PULL_UNITS = 10**15
POOL = "(small sources)"
NONE = "(no source)"


def whole_weights(weights: dict[str, float], units: int = UNITS) -> dict[str, int]:
    """Weights as whole units with the sum ``units``, at least 1 each (largest remainders first)."""
    total = sum(weights.values())
    if not weights or total <= 0 or len(weights) > units:
        raise ValueError("weights must be positive and no more than there are units")
    exact = {s: w * units / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    i = 0
    while (left := units - sum(out.values())) != 0:
        s = by_rest[i % len(by_rest)] if left > 0 else max(out, key=lambda x: (out[x], x))
        out[s] += 1 if left > 0 else -1
        i += 1
    return out


def pfair_period(units: dict[str, int]) -> list[str]:
    """Source of each slot of one period: earliest deadline first among released blocks."""
    total = sum(units.values())
    release = lambda k, w: k * total // w
    deadline = lambda k, w: -(-(k + 1) * total // w)
    waiting = [(0, deadline(0, w), s, 0) for s, w in units.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        slots.append(s)
        w = units[s]
        heapq.heappush(waiting, (release(k + 1, w), deadline(k + 1, w), s, k + 1))
    return slots


def tempered_weights(sizes: dict[str, int], temperature: float = TEMPERATURE, total: int | None = None) -> dict[str, float]:
    """Targets that raise small sources a little: character shares to a power below 1."""
    total = total or sum(sizes.values()) or 1
    return {s: max(n / total, 1e-12) ** temperature for s, n in sizes.items()}


def mix_slots(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, units: int = UNITS) -> DataFrame:
    """``(doc_id, _id, _th, source, stream, epoch, block, slot)``, a row per placed document.

    ``weights`` gives the target of each source, whatever its size (sources it does not name
    share the stream of small ones with what ``POOL`` says, or with the smallest weight);
    by default it is ``tempered_weights`` of the characters of each. ``block_chars`` is lowered
    to the size of the smallest source with a stream of its own.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), source,
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("chars"),
        *key_columns(),
    )
    total, n_rows = rows.agg(F.sum("chars"), F.count("*")).first()
    if not n_rows:
        return rows.select("doc_id", "_id", "_th", "source", F.col("source").alias("stream"), *[F.lit(0).cast("bigint").alias(c) for c in ("epoch", "block", "slot")])
    total = int(total)
    totals = rows.groupBy("source").agg(F.sum("chars").alias("n"))
    # at most GROUPS sources reach the share
    own = F.col("n") >= F.lit(max(1, ceil(total / GROUPS))) if weights is None else F.col("source").isin(list(weights))
    sizes = {r.source: int(r.n) for r in totals.where(own).collect()}
    named = sorted(sizes)
    is_own = F.col("source").isin(named) if named else F.lit(False)
    rows = rows.withColumn("stream", F.when(is_own, F.col("source")).otherwise(F.lit(POOL)))

    # whole numbers, so that their sum does not depend on the order
    size = F.greatest(F.col("n"), F.lit(1))
    pull = F.greatest(F.round(F.pow(size / F.lit(max(1, total)), F.lit(TEMPERATURE)) * PULL_UNITS).cast("bigint"), F.lit(1)).alias("_pull")
    pooled = totals.where(~is_own).select(size.alias("n"), pull).agg(F.sum("_pull").alias("pull"), F.max(F.col("n") / F.col("_pull")).alias("last"))
    pool = pooled.first()
    target = tempered_weights(sizes, total=total) if weights is None else {s: weights[s] for s in sizes}
    if pool.pull:
        target[POOL] = pool.pull / PULL_UNITS if weights is None else weights.get(POOL, min(weights.values()))
    share = whole_weights(target, units)
    period = pfair_period(share)
    places: dict[str, list[int]] = {s: [] for s in share}
    for slot, s in enumerate(period):
        places[s].append(slot)

    # characters of a block; blocks of a stream whose share was raised to a whole unit hold less
    full = max(1, min([block_chars, max(1, total), *[n for n in sizes.values() if n]]))
    exact = {s: w * units / sum(target.values()) for s, w in target.items()}
    length = {s: full * exact[s] if 0 < exact[s] < 1 else float(full) for s in share}
    # characters of the stream until all is placed once; a source without any comes once a block
    once = {s: float(n) or length[s] for s, n in sizes.items()}
    if pool.pull:
        once[POOL] = pool.last * float(pool.pull)
    # a document of length 0 at the very end of a source starts in a further block
    blocks = {s: floor(once[s] / length[s]) + 1 for s in share}
    slot_of = lambda s, k: k // share[s] * units + places[s][k % share[s]]
    end = 1 + max(slot_of(s, blocks[s] - 1) for s in share)
    used = {s: end // units * share[s] + sum(1 for slot in places[s] if slot < end % units) for s in share}
    # a last block in which all has been placed is not filled up again
    limit = {s: once[s] if used[s] == blocks[s] else used[s] * length[s] for s in share}

    # place in the source: cells in a hashed order, sums by cell, running sums over cells
    cells = parts_for(n_rows, CELL_ROWS)
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(F.lit("mix"), "_id", "_th"), F.lit(cells)))
    sums = rows.groupBy("source", "_cell").agg(F.sum("chars").alias("_n"))
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(of_source).alias("n"))
    starts = starts.select("source", "_cell", "_start", size.cast("double").alias("_size"), pull)
    inside = Window.partitionBy("source", "_cell").orderBy("_id", "_th").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(starts, ["source", "_cell"])

    facts = [(s, share[s], used[s], length[s], limit[s], once[s]) for s in share]
    streams = spark.createDataFrame(facts, "stream string, _share bigint, _used bigint, _length double, _limit double, _once double")
    table = spark.createDataFrame([(s, k, slot) for s in share for k, slot in enumerate(places[s])], "stream string, _k bigint, _slot bigint")
    # at most ``units`` and exactly ``units`` rows
    out = placed.join(F.broadcast(streams), "stream")
    in_pool = F.lit(False) if not pool.pull else F.col("stream") == POOL
    out = out.withColumn("_period", F.when(in_pool, F.col("_size")).otherwise(F.col("_once")))
    at = (F.col("_start") + F.col("_in")).cast("double")
    turn = F.pmod(F.xxhash64(F.lit("turn"), "source"), F.lit(1 << 30)) / float(1 << 30) * F.col("_size")
    out = out.withColumn("_at", F.when(in_pool, F.pmod(at + turn, F.col("_size"))).otherwise(at))
    # characters of the stream for a character of the source
    stretch = F.when(in_pool, F.lit(float(pool.pull or 1)))
    due = lambda x: F.when(in_pool, x / F.col("_pull") * stretch).otherwise(x)
    last = F.greatest(F.ceil((F.col("_limit") - due(F.col("_at"))) / due(F.col("_period"))).cast("bigint"), F.lit(0).cast("bigint"))
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    out = out.withColumn("_due", due(F.col("_at") + F.col("epoch") * F.col("_period"))).where((F.col("epoch") == 0) | (F.col("_due") < F.col("_limit")))
    out = out.withColumn("block", F.least(F.floor(F.col("_due") / F.col("_length")), F.col("_used") - 1))
    out = out.withColumn("_k", F.col("block") % F.col("_share")).join(F.broadcast(table), ["stream", "_k"])
    slot = F.floor(F.col("block") / F.col("_share")) * units + F.col("_slot")
    return out.select("doc_id", "_id", "_th", "source", "stream", "epoch", "block", slot.alias("slot"))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of the placed documents, a row for each epoch, sorted by slot: written
    to files, the parts in order are the mix, and each prefix of them has the target weights."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("_source")
    one = [*KEY, "_source"]
    # repeated rows are numbered, and in each epoch the n-th takes the n-th of their slots
    number = lambda *by: F.row_number().over(Window.partitionBy(*one, *by).orderBy("slot" if by else F.lit(0)))
    slots = mix_slots(docs, weights, block_chars).withColumnRenamed("source", "_source").withColumn("_copy", number("epoch"))
    slots = slots.groupBy(*one, "_copy").agg(F.collect_list("slot").alias("_slots"))
    rows = docs.select(F.struct("*").alias("_row"), *key_columns(), source).withColumn("_copy", number())
    placed = rows.join(slots, [*one, "_copy"]).withColumn("_slot", F.explode("_slots")).drop("_slots")
    return placed.repartitionByRange("_slot").sortWithinPartitions("_slot", *KEY).select("_row.*")
