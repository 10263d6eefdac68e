"""Ranked lexical search by best-first splitting of document intervals.

The documents are dealt into chunks where they lie. A chunk holds a posting list (places and
impacts) for each term of the queries, and over all lists a sparse table of range maxima: the
place of the largest impact of any stretch of a list is known in two looks. A query starts with the
whole chunk as one interval. The bound of an interval is the sum of its terms' range maxima.
The intervals of the largest bounds are taken up, a batch at a time; each is split at the
document of its largest single impact, that document is scored exactly, and the two intervals
left of it and right of it get bounds of their own. The search ends when no bound reaches the
``k``-th best score; a task carries its best over to its next chunk, so later
chunks are mostly ruled out. The best of all tasks are then merged.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. With N documents that hold a term, L terms in all, n terms in a document and df
documents that hold a term, the term weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and
adds that times ``10^9 tf div (1000 tf + 8 m)``, where ``m`` is ``10 + (90 n N) div L``.
Equal scores go by ascending ``doc_id``; documents with score 0 are left out.

Queries are answered in blocks of about ``QUERY_BYTES`` characters, so the vocabulary that
tasks hold is bounded whatever the number of queries; each block is one pass over the texts.
A null text has no terms. Each row is a document of its own, so repeated rows are ranked
each; null ids come first among equal scores. Queries are distinct ``(item_id, text)``; one without
terms, and an empty table, give no rows. Long texts are counted in pieces of ``_PIECE`` bytes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarespark.llm.rows import NO_ID, parts_for
from rarespark.session import materialize

TOP = 10
QUERY_BYTES = 8 << 20
CHUNK_DOCS, CHUNK_POSTINGS = 8192, 1 << 20
BATCH = 256
_PIECE = 1 << 20
_KEPT = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_AS_TERMS = bytes(b if b in _KEPT else 32 for b in bytes(range(256)).lower())

_INDEX = "ids binary, sizes binary, nonempty bigint, total bigint, terms array<int>, dfs array<int>, places binary, tfs binary"


def _pieces(data: bytes):
    """The terms of UTF-8 ``data``, in lists of bounded pieces cut between terms."""
    data = data.translate(_AS_TERMS)
    at = 0
    while at < len(data):
        cut = len(data) if len(data) - at <= _PIECE else data.rfind(b" ", at, at + _PIECE)
        if cut <= at:
            cut = data.find(b" ", at + 1)
            cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def term_counts(data: bytes) -> tuple[Counter, int]:
    """(occurrences by term, number of terms)."""
    counts: Counter = Counter()
    for terms in _pieces(data):
        counts.update(terms)
    return counts, sum(counts.values())


def index_chunks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row for each chunk of documents: ids, sizes, and the postings of the vocabulary.

    Inside a chunk, documents stand by their most frequent query term and by size, so that
    neighbours answer alike and intervals have tight bounds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches):
        known = shared.value
        ids, sizes, mains, terms, owners, tfs = [], [], [], [], [], []

        def chunk():
            size, main, own = np.array(sizes, np.int64), np.array(mains), np.array(owners, np.int64)
            order = np.lexsort((np.array(ids, np.int64), size, main))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            term, tf = np.array(terms, np.int32), np.array(tfs, np.int32)
            posted = np.lexsort((place[own], term)) if len(own) else np.empty(0, np.int64)
            used, dfs = np.unique(term, return_counts=True)
            row = {
                "ids": np.array(ids, "<i8")[order].tobytes(), "sizes": size[order].astype("<i8").tobytes(),
                "nonempty": int((size > 0).sum()), "total": int(size.sum()), "terms": used.tolist(), "dfs": dfs.tolist(),
                "places": place[own][posted].astype("<i4").tobytes(), "tfs": tf[posted].astype("<i4").tobytes(),
            }
            for kept in (ids, sizes, mains, terms, owners, tfs):
                kept.clear()
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts, n = term_counts(text.as_buffer().to_pybytes())
                best, main = 0, -1
                for term, tf in counts.items():
                    number = known.get(term)
                    if number is not None:
                        terms.append(number), owners.append(len(ids)), tfs.append(tf)
                        if tf > best or (tf == best and number < main):
                            best, main = tf, number
                ids.append(doc_id), sizes.append(n), mains.append(main)
                if len(ids) >= CHUNK_DOCS or len(terms) >= CHUNK_POSTINGS:
                    yield chunk()
        if ids:
            yield chunk()

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    )
    return rows.mapInArrow(index, _INDEX)


class Chunk:
    """The posting lists of a chunk with their range maxima."""

    def __init__(self, ids, sizes, terms, dfs, places, tfs, documents: int, total: int):
        self.ids, self.width = ids, len(ids)
        m = 10 + (90 * sizes * documents) // max(total, 1)
        tf = tfs.astype(np.int64)
        self.place, self.value = places, (1_000_000_000 * tf) // (1000 * tf + 8 * m[places])
        self.ends = np.cumsum(dfs)
        self.starts = self.ends - dfs
        self.slot_of = {t: i for i, t in enumerate(terms)}
        # lists one after the other, so one sorted array finds a place in any of them
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), dfs) * self.width + places
        levels = [np.arange(len(places), dtype=np.int32)]
        step = 1
        while 2 * step <= (max(dfs) if len(dfs) else 0):
            low = levels[-1]
            high = np.concatenate([low[step:], low[len(low) - step :]])
            # stretches over the end of a list are never asked for
            levels.append(np.where(self.value[high] > self.value[low], high, low))
            step *= 2
        self.levels = np.stack(levels)
        self.log = np.zeros(len(places) + 2, np.int8)
        for power in range(1, len(levels)):
            self.log[1 << power :] = power

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in the lists of the largest impact of each stretch ``[a, b)``; any place where it is empty."""
        if not len(self.value):
            return np.zeros(a.shape, np.int64)
        power = self.log[np.maximum(b - a, 1)]
        last = len(self.value) - 1
        left = self.levels[power, np.minimum(a, last)]
        right = self.levels[power, np.clip(b - (1 << power.astype(np.int64)), 0, last)]
        return np.where(self.value[right] > self.value[left], right, left)

    def search(self, terms: list[int], weights: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best``: up to ``k`` pairs ``(score, -doc_id)`` from the highest on, brought up to date with this chunk."""
        have = [(self.slot_of[t], weights[t]) for t in terms if t in self.slot_of and weights[t] > 0]
        if not have:
            return best
        slots, w = np.array([s for s, _ in have]), np.array([x for _, x in have], np.int64)
        base = slots * self.width
        a, b = self.starts[slots][None, :], self.ends[slots][None, :]
        bound, split = self._bounds(a, b, w)
        batch = 1
        while len(bound):
            floor = best[-1][0] if len(best) == k else 1
            alive = bound >= floor
            if not alive.all():
                a, b, bound, split = a[alive], b[alive], bound[alive], split[alive]
                if not len(bound):
                    break
            if len(bound) > batch:
                order = np.argpartition(-bound, batch - 1)
                taken, rest = order[:batch], order[batch:]
            else:
                taken, rest = np.arange(len(bound)), np.empty(0, np.int64)
            batch = min(2 * batch, BATCH)
            at, low, high = split[taken], a[taken], b[taken]
            middle = np.searchsorted(self.keys, base[None, :] + at[:, None])
            inside = np.minimum(middle, len(self.keys) - 1)
            hit = (middle < high) & (self.place[inside] == at[:, None])
            scores = (w * self.value[inside] * hit).sum(1)
            good = np.flatnonzero(scores >= floor)
            if len(good):
                found = [(int(s), -int(d)) for s, d in zip(scores[good], self.ids[at[good]])]
                best = sorted(best + found, reverse=True)[:k]
                floor = best[-1][0] if len(best) == k else 1
            new_a, new_b = np.concatenate([low, middle + hit]), np.concatenate([middle, high])
            new_bound, new_split = self._bounds(new_a, new_b, w)
            keep = new_bound >= floor
            a, b = np.concatenate([a[rest], new_a[keep]]), np.concatenate([b[rest], new_b[keep]])
            bound, split = np.concatenate([bound[rest], new_bound[keep]]), np.concatenate([split[rest], new_split[keep]])
        return best

    def _bounds(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed range maxima, document of the largest single one) of each interval."""
        tops = self.maxima(a, b)
        impact = np.where(b > a, w * self.value[tops], 0)
        most = impact.argmax(1)
        return impact.sum(1), self.place[tops[np.arange(len(tops)), most]]


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """Answers of one block of queries: ``(item_id, rank, doc_id, score)``."""
    spark = docs.sparkSession
    wanted = [sorted(term_counts(item.text.encode("utf-8", "surrogatepass"))[0]) for item in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in wanted for t in terms}))}
    index = materialize(index_chunks(docs, vocabulary), "lexical-index")
    counts = index.agg(F.sum("nonempty").alias("n"), F.sum("total").alias("l")).first()
    documents, total = counts["n"] or 0, counts["l"] or 0
    weights = np.zeros(len(vocabulary), np.int64)
    frequencies = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
    for row in frequencies.collect():  # at most the vocabulary of the block
        weights[row["terms"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["df"] + 1)))
    shared = spark.sparkContext.broadcast((weights, [[vocabulary[t] for t in terms] for terms in wanted]))

    def search(batches):
        weights, queries = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                numbers = [np.frombuffer(row[c], kind) for c, kind in (("ids", "<i8"), ("sizes", "<i8"), ("places", "<i4"), ("tfs", "<i4"))]
                ids, sizes, places, tfs = numbers
                chunk = Chunk(ids, sizes, row["terms"], np.array(row["dfs"], np.int64), places, tfs, documents, total)
                for i, terms in enumerate(queries):
                    best[i] = chunk.search(terms, weights, k, best[i])
        rows = [(i, -d, s) for i, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item", "doc_id", "score"])

    found = index.select("ids", "sizes", "terms", "dfs", "places", "tfs").mapInArrow(search, "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item.item_id) for i, item in enumerate(items)], "item bigint, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` best of ``docs(doc_id, text)`` for each of ``queries(item_id, text)``: ``(item_id, rank, doc_id, score)``."""
    items = queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = materialize(items, "lexical-queries")
    blocks = parts_for(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"], query_bytes)
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))
    answers = None
    for number in range(blocks):
        # about query_bytes characters
        some = _search_block(docs, items.where(block == number).orderBy("item_id", "text").collect(), k)
        answers = some if answers is None else answers.unionByName(some)
    return answers
