"""Removing bytes of long strings that occur more than once, by suffix arrays of bounded bundles.

Sorting all suffixes of a corpus is not needed to find equal strings of ``LENGTH``
bytes. Each such window has an anchor, its leftmost ``GRAM``-byte string with the lowest hash,
which depends on the window's bytes only. Neighbouring windows with one anchor form a segment, some 280 bytes,
and equal windows lie in segments with equal anchors:

1. Anchors are counted by hash, with the lowest and the highest hash of their segments.
   An anchor that occurs once has no repeated window. If all segments of an anchor are
   equal, all their windows are repeated. Neither needs its bytes.
2. Of the other anchors, the different segments are fetched once each, and put into
   bundles of about ``BUNDLE_BYTES``. A bundle's suffix array is built in two stages: suffixes
   smaller than their successors are sorted directly, the others induced by scanning the buckets.
   Adjacent common prefixes of at least ``LENGTH`` give the repeated windows.
3. An anchor with more than ``PART_SEGMENTS`` different segments is split over bundles. Windows
   without a partner there are compared across its bundles by 128-bit hashes.

Segments are equal if anchor hash and segment hash (128 bits together) are.

Null text is empty; texts shorter than ``LENGTH`` lose nothing; a row that is
repeated is an occurrence of its own, so both lose what is repeated; rows with one
``doc_id`` and other texts are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.prefilter import mark_possible, possible_partners
from rarespark.llm.rows import KEY, keyed, parts_for
from rarespark.llm.shingles import mix64, powers
from rarespark.session import materialize

LENGTH = 200
GRAM = 32
BUNDLE_BYTES = 256 << 10
PART_SEGMENTS = 2_000
_CHUNK = 2 << 20

def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes: differences of a running polynomial, shifted back to power 0."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    up, down = powers(n)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix64((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])


def segments_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first window start, last window start, anchor hash) of each segment of the concatenated texts."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    hashes = _gram_hashes(data, gram)
    # leftmost lowest: 32 bits of the hash, then the place
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = length - gram + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    anchors = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(windows, bool)
    start = 0
    for end in ends.tolist():
        inside[max(start, end - length + 1) : end] = False
        start = end
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none.astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (anchors[at[1:]] != anchors[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], hashes[anchors[at[first]]]


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """``(h, g, _id, _th, lo, windows)`` of every segment of every row."""
    names = ["h", "g", *KEY, "lo", "windows"]

    def chunks(batches):
        texts, keys, size = [], [], 0
        for batch in batches:
            for text, key, th in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                texts.append(data), keys.append((key, th))
                size += len(data)
                if size >= _CHUNK:
                    yield texts, keys
                    texts, keys, size = [], [], 0
        if texts:
            yield texts, keys

    def find(batches):
        digest = xxhash.xxh3_64_intdigest
        for texts, keys in chunks(batches):
            whole = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            low, high, h = segments_of(np.frombuffer(whole, "u1"), ends, length)
            doc = np.searchsorted(ends, low, "right")
            begins = np.concatenate([[0], ends[:-1]])
            g = np.array([digest(whole[a:b]) for a, b in zip(low.tolist(), (high + length).tolist())], np.uint64)
            key = np.array(keys, np.int64).reshape(-1, 2)[doc]
            columns = [h.view(np.int64), g.view(np.int64), key[:, 0], key[:, 1], low - begins[doc], high - low + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names)

    return docs.select("text", *KEY).mapInArrow(find, ", ".join(f"{n} bigint" for n in names))


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes (or more); ties in any order.

    Stage 1 sorts the suffixes that are smaller than their successors. Stage 2 scans the
    buckets from the lowest first byte on: the suffix one byte before a sorted one, if it is
    larger than its successor, is the next in its own bucket.
    """
    t = np.frombuffer(data, "u1")
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    differs = np.append(t[:-1] != t[1:], True)
    next_differing = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = np.append(t[:-1] < t[1:], False)[next_differing]
    direct = np.flatnonzero(smaller)
    cuts = [data[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(cuts)), key=cuts.__getitem__)]
    ends = np.cumsum(np.bincount(t, minlength=256))
    direct_counts = np.bincount(t[direct], minlength=256)
    direct_starts = np.concatenate([[0], np.cumsum(direct_counts)])
    nxt = ends - np.bincount(t, minlength=256)
    out = np.full(n, -1)
    for c in range(256):
        k = direct_counts[c]
        out[ends[c] - k : ends[c]] = direct[direct_starts[c] : direct_starts[c] + k]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        counts = np.bincount(first, minlength=256)
        group = np.cumsum(counts) - counts
        out[nxt[first] + np.arange(len(before)) - group[first]] = before
        nxt[:] += counts

    out[nxt[t[-1]]] = n - 1
    nxt[t[-1]] += 1
    begins = ends - np.bincount(t, minlength=256)
    for c in np.unique(t).tolist():
        done = begins[c]
        while done < nxt[c]:
            found, done = out[done : nxt[c]], nxt[c]
            induce(found)
        induce(out[ends[c] - direct_counts[c] : ends[c]])
    return out


def shared_prefixes(data: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in ``order`` shares at least ``length`` bytes with the one before (the first: no)."""
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    step = 8 if length % 8 == 0 else 1
    t = np.frombuffer(data + bytes(8), "u1")
    if step == 8:
        words = np.zeros(len(data), np.uint64)
        for i in range(8):
            words = (words << np.uint64(8)) | t[i : i + len(data)]
    else:
        words = t[: len(data)]
    k = np.arange(1, len(order))
    for at in range(0, length, step):
        k = k[words[order[k] + at] == words[order[k - 1] + at]]
    out[k] = True
    return out


def repeated_windows(pieces: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece: (which window starts occur elsewhere in the pieces, class of each window)."""
    data = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    valid = np.zeros(len(data), bool)
    for s, size in zip(starts.tolist(), sizes.tolist()):
        valid[s : s + size - length + 1] = True
    order = suffix_array(data, length)
    order = order[valid[order]]
    same = shared_prefixes(data, order, length)
    repeated, number = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
    repeated[order[same]] = True
    repeated[order[np.flatnonzero(same) - 1]] = True
    number[order] = np.cumsum(~same)
    return [(repeated[s : s + size - length + 1], number[s : s + size - length + 1]) for s, size in zip(starts.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(a, b - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


RANGE, OPEN, CLOSED = 0, 1, 2


def _bundle_matches(pieces: DataFrame, length: int) -> DataFrame:
    """``(seg, lo, hi, k1, k2, kind)`` from ``(b1, b2, seg, data)``.

    ``RANGE``: windows lo..hi are repeated. For split anchors also ``OPEN``: a window without
    partner so far, and ``CLOSED``: one of each class of repeated windows, both with the window's hash.
    """
    names = ["seg", "lo", "hi", "k1", "k2", "kind"]

    def match(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (_, part), group in groupby(rows, key=lambda r: r[:2]):
            found, segs, data = [], [], []
            for row in group:
                if segs and segs[-1] == row[2]:
                    continue  # a repeated row
                segs.append(row[2]), data.append(row[3])
            told: set[int] = set()
            for seg, piece, (repeated, number) in zip(segs, data, repeated_windows(data, length)):
                found += [(seg, a, b, None, None, RANGE) for a, b in _runs(repeated)]
                if part < 0:
                    continue
                for i, (is_found, c) in enumerate(zip(repeated.tolist(), number.tolist())):
                    if is_found and c in told:
                        continue
                    told.add(c)
                    digest = xxhash.xxh3_128_digest(piece[i : i + length])
                    k1, k2 = (int.from_bytes(digest[x : x + 8], "little", signed=True) for x in (0, 8))
                    found.append((seg, i, i, k1, k2, CLOSED if is_found else OPEN))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    rows = pieces.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "seg").select("b1", "b2", "seg", "data")
    return rows.mapInArrow(match, ", ".join(f"{n} bigint" for n in names))


def _fetch(docs: DataFrame, segments: DataFrame, length: int) -> DataFrame:
    """``(b1, b2, seg, data)``: the bytes of one occurrence of each segment."""
    wanted = segments.groupBy(*KEY).agg(F.collect_list(F.struct("b1", "b2", "seg", "lo", "windows")).alias("wanted"))
    texts = possible_partners(docs.select("text", *KEY), wanted, KEY).join(wanted, KEY).select("text", "wanted")

    def cut(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    out.append((w["b1"], w["b2"], w["seg"], data[w["lo"] : w["lo"] + w["windows"] + length - 1]))
            if out:
                kinds = [pa.int64()] * 3 + [pa.binary()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["b1", "b2", "seg", "data"])

    return texts.mapInArrow(cut, "b1 bigint, b2 bigint, seg bigint, data binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """``(_id, _th, spans array<struct<lo, hi>>)``: byte ranges [lo, hi) to remove, unmerged,
    of each document that has any. ``docs`` has ``text`` and the key columns."""
    found = _segments(docs, length)
    anchors = found.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    anchors = materialize(anchors.where("n > 1").select("h", (F.col("g0") == F.col("g1")).alias("same")), "anchors")
    shared = materialize(possible_partners(found, anchors, ["h"]).join(anchors, "h"), "shared-segments")
    mixed = shared.where("NOT same")

    one = mixed.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "lo", "windows")).alias("at"))
    one = materialize(one.select(F.monotonically_increasing_id().alias("seg"), "h", "g", "n", "at.*"), "segments")
    total = one.agg(F.sum(F.col("windows") + length - 1)).first()[0] or 0
    sizes = one.groupBy("h").agg(F.ceil(F.count("*") / part_segments).alias("_parts"))
    whole = F.col("_parts") == 1
    bundled = one.join(sizes, "h").select(
        "seg", *KEY, "lo", "windows",
        F.when(whole, F.pmod(F.xxhash64("h"), F.lit(parts_for(total, BUNDLE_BYTES)))).otherwise(F.col("h")).alias("b1"),
        F.when(whole, F.lit(-1)).otherwise(F.pmod(F.xxhash64("seg"), F.col("_parts"))).cast("bigint").alias("b2"),
    )
    matches = materialize(_bundle_matches(_fetch(docs, bundled, length), length), "matches")
    ranges = matches.where(F.col("kind") == RANGE).select("seg", "lo", "hi")
    keyed_windows = matches.where(F.col("kind") != RANGE)
    met = keyed_windows.groupBy("k1", "k2").agg(F.count("*").alias("_n"), F.min("kind").alias("_kind")).where((F.col("_n") > 1) & (F.col("_kind") == OPEN))
    across = keyed_windows.where(F.col("kind") == OPEN).join(met.select("k1", "k2"), ["k1", "k2"]).select("seg", "lo", "hi")

    span = lambda lo, hi: F.struct(lo.alias("lo"), (hi + length).alias("hi"))
    all_of = span(F.col("lo"), F.col("lo") + F.col("windows") - 1)
    equal = shared.where("same").select(*KEY, all_of.alias("span"))
    often = mixed.join(one.where("n > 1").select("h", "g"), ["h", "g"]).select(*KEY, all_of.alias("span"))
    single = one.where("n = 1").select("seg", *KEY, F.col("lo").alias("base"))
    partly = ranges.unionByName(across).join(single, "seg")
    partly = partly.select(*KEY, span(F.col("base") + F.col("lo"), F.col("base") + F.col("hi")).alias("span"))
    every = equal.unionByName(often).unionByName(partly)
    return every.groupBy(*KEY).agg(F.collect_set("span").alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary)`` of every row: the bytes left after
    all repeated windows are taken out. Cuts may fall inside a character."""
    rows = keyed(docs)
    spans = materialize(repeated_spans(rows, length, part_segments), "spans")
    marked = mark_possible(rows, spans, KEY)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    untouched = marked.where("NOT _maybe").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.col("text").cast("binary").alias("kept"),
    )
    joined = marked.where("_maybe").drop("_maybe").join(spans, KEY, "left").select("doc_id", "text", "spans")

    def remove(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                merged = merge_spans([(s["lo"], s["hi"]) for s in found or []])
                out.append((len(data), sum(b - a for a, b in merged), len(merged), without_spans(data, merged)))
            if out:
                kinds = [pa.int64()] * 3 + [pa.binary()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return untouched.unionByName(joined.mapInArrow(remove, schema))
