"""Removing lines that nearly repeat an earlier line, by an exact set-similarity join.

A line's tokens are its distinct five-word shingles (its word sequence, if it has fewer
words); lines are alike from a Jaccard similarity of 0.75 on. Tokens are put in
one global order, the rare ones first: a shingle is the rarer the rarer its words are, by
counts of words in ``SLOTS`` hashed counters (8 MB, whatever the data; far fewer words are distinct than
shingles). Alike lines of ``n`` tokens share at least ``k`` of their first ``n - ceil(0.75 n) + k``:

1. Prefix: a bitmap of ``SLOT_BITS`` slots (64 MB) marks the prefix tokens (``k = SHARED``) that lines with other
   token sets have too. Lines with fewer than ``k`` marked tokens have no match but equal lines.
2. The others meet by marked token of the shortest prefix (``k = 1``), with their size, the token's position and a print: parities
   of the tokens by their low bits, about a bit for each token. Length and positional filters and the prints (which differ in
   at most as many bits as the sets do in tokens) rule out nearly all pairs. Each line passes on up to
   ``PARTNERS`` earlier partners, in effect alike ones, so a family of copies makes no pairs of all with all.
3. One such pair of each line is verified on the whole sets. Lines whose pair does not hold, and which had more, look again by
   prints ``FINER`` times as wide, which leave few pairs that are not alike: at one partner, then at all of theirs. Tokens of more than
   ``block`` lines meet in pairs of blocks.

A line is removed if an earlier line (by ``doc_id``, then place) has the same tokens or is
alike, be the earlier one itself removed or not. So the verdicts depend on no order of
work.

Lines without words stay. Null text is empty and stays null. Rows with one ``doc_id`` and
other texts are separate documents, ordered by their hashes; of repeated rows all copies get the same
verdicts (they are one document). A document none of whose words stay is dropped.
Null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.prefilter import mark_possible, possible_partners
from rarespark.llm.rows import KEY, few_rows, keyed, wrapped
from rarespark.llm.shingles import SHINGLE, chained, mix64, word_hashes
from rarespark.operators.joins import heavy_keys, salted_join
from rarespark.session import materialize

SLOTS = 1 << 20
_BLOBS = 64
SLOT_BITS, SLOT_BLOBS = 29, 256
BLOCK = 32768
PARTNERS = 1
LEAST_BITS = 128
LEAST_TOKENS = 3
SHARED = 4
_CHUNK = 1 << 17  # the arrays of a chunk stay in the processor's cache
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_HELD = 1 << 21
_AT_ONCE = 1 << 16
_AT_ONCE_BYTES = 8 << 20
_ROWS = 256
FINER = 8


def shared_tokens(n: np.ndarray) -> np.ndarray:
    """How many tokens of their prefixes alike lines have to share."""
    return np.minimum(SHARED, -(-3 * n // 4))


def prefix_length(n: np.ndarray, shared) -> np.ndarray:
    """So many first tokens that alike lines share ``shared`` of them."""
    return n - -(-3 * n // 4) + shared


def line_tokens(data: bytes, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(line number, token hash, summed level of its words) with repeats, and the number of lines of a lowered text."""
    starts, h = word_hashes(data)
    breaks = np.flatnonzero(np.frombuffer(data, "u1") == 10)
    counts = np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(h))
    line = np.repeat(np.arange(len(counts)), counts)
    level = np.zeros(len(h), np.uint8) if levels is None else levels[(h >> np.uint64(44)).view(np.int64)]
    lines, tokens, sums = [], [], []
    if len(h) >= SHINGLE:
        n = len(h) - SHINGLE + 1
        whole = np.flatnonzero(line[:n] == line[SHINGLE - 1 :])
        lines.append(line[:n][whole]), tokens.append(chained(h, SHINGLE, n)[whole])
        total = np.zeros(len(h) + 1, np.int64)
        np.cumsum(level, out=total[1:])
        sums.append(total[whole + SHINGLE] - total[whole])
    first = np.cumsum(counts) - counts
    for words in range(1, SHINGLE):
        short = np.flatnonzero(counts == words)
        if len(short):
            run = h[first[short][:, None] + np.arange(words)]
            found = mix64(run[:, 0] + np.uint64(words))
            for i in range(1, words):
                found = mix64(found + run[:, i])
            lines.append(short), tokens.append(found), sums.append(np.zeros(len(short), np.int64))
    if not lines:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), len(breaks) + 1
    return np.concatenate(lines), np.concatenate(tokens), np.concatenate(sums), len(breaks) + 1


def _rows(batch: pa.RecordBatch):
    """(bytes of the text, key, hash) of each row, made for a few rows at a time; texts needn't be decoded for it."""
    texts, keys, hashes = batch.columns[:3]
    texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    for at in range(0, len(texts), _ROWS):
        yield from zip(*(c.slice(at, _ROWS).to_pylist() for c in (texts, keys, hashes)))


def _chunks(batches):
    """(lowered bytes, [(key, first line here, line number in the document, lines)]) of about ``_CHUNK`` bytes.

    A long text is cut at line ends."""
    parts, said, size, line = [], [], 0, 0
    for batch in batches:
        for data, key, th in _rows(batch):
            data, at, own = data.lower(), 0, 0
            while True:
                cut = len(data) if len(data) - at <= _CHUNK else data.rfind(b"\n", at, at + _CHUNK)
                if cut < 0:
                    cut = data.find(b"\n", at) if data.find(b"\n", at) >= 0 else len(data)
                piece = data[at:cut]
                n = piece.count(b"\n") + 1
                parts.append(piece), said.append((key, th, line, own, n))
                size, line, own = size + len(piece), line + n, own + n
                if size >= _CHUNK:
                    yield b"\n".join(parts), said
                    parts, said, size, line = [], [], 0, 0
                if cut == len(data):
                    break
                at = cut + 1
    if parts:
        yield b"\n".join(parts), said


def word_levels(docs: DataFrame) -> np.ndarray:
    """Level of each counter of words: twice the binary logarithm of its count."""

    def count(batches):
        counters = np.zeros(SLOTS, np.int64)
        held, size = [], 0
        for data, _ in _chunks(batches):
            _, h = word_hashes(data)
            held.append((h >> np.uint64(44)).astype(np.int32))
            size += len(h)
            if size > SLOTS:
                counters += np.bincount(np.concatenate(held), minlength=SLOTS)
                held, size = [], 0
        if held:
            counters += np.bincount(np.concatenate(held), minlength=SLOTS)
        blobs = [b.astype("<i8").tobytes() for b in counters.reshape(_BLOBS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOBS), pa.int64()), pa.array(blobs, pa.binary())], ["blob", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for blob, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[blob] = sums.get(blob, 0) + np.frombuffer(counts, "<i8")
        blobs = [s.tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(blobs, pa.binary())], ["blob", "counts"])

    schema = "blob bigint, counts binary"
    summed = docs.select("text", *KEY).mapInArrow(count, schema).repartition(_BLOBS, "blob").mapInArrow(add, schema)
    counters = np.zeros((_BLOBS, SLOTS // _BLOBS), np.int64)
    for row in summed.collect():  # _BLOBS rows
        counters[row.blob] = np.frombuffer(row.counts, "<i8")
    return np.round(2 * np.log2(np.maximum(counters.ravel(), 1))).astype(np.uint8)


class _Lines:
    """The token sets of the lines of a chunk, each in the global order."""

    def __init__(self, data: bytes, levels: np.ndarray):
        line, tokens, level, total = line_tokens(data, levels)
        packed = tokens >> np.uint64(35)
        packed |= ((line << 11) | level).view(np.uint64) << np.uint64(29)
        order = np.argsort(packed)
        packed, tokens = packed[order], tokens[order]
        if ((packed[1:] == packed[:-1]) & (tokens[1:] < tokens[:-1])).any():
            again = np.lexsort((tokens, packed))
            packed, tokens, order = packed[again], tokens[again], order[again]
        line = (packed >> np.uint64(40)).view(np.int64)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (tokens[1:] != tokens[:-1])
        line, self.tokens = line[new], tokens[new]
        n = np.bincount(line, minlength=total)
        self.used = np.flatnonzero(n)
        self.n = n[self.used]
        self.begins = np.cumsum(self.n) - self.n
        self.shared = shared_tokens(self.n)
        if len(self.used):
            self.c1 = np.add.reduceat(mix64(self.tokens), self.begins)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, place there) of the tokens of the prefixes; shorter lines are alike to equal ones only."""
        sizes = np.where(self.n >= LEAST_TOKENS, prefix_length(self.n, self.shared), 0)
        own = np.repeat(np.arange(len(sizes)), sizes)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def c2(self) -> np.ndarray:
        """Second hashes of the token sets; only the lines that are written need them."""
        return np.add.reduceat(mix64(self.tokens ^ _SECOND), self.begins)


def shared_slots(docs: DataFrame, levels: np.ndarray) -> np.ndarray:
    """Bitmap of the slots that prefix tokens of lines with different token sets fall into."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    width = (1 << SLOT_BITS) // SLOT_BLOBS

    def find(batches):
        held, size = [], 0

        def blobs():
            # np.unique makes a hash table, which takes several times a sort
            every = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            every = every[np.append(True, every[1:] != every[:-1])] if len(every) else every
            cuts = np.searchsorted(every, np.arange(1, SLOT_BLOBS, dtype=np.uint64) * np.uint64(width) << np.uint64(32))
            parts = [p.astype("<u8").tobytes() for p in np.split(every, cuts)]
            return pa.RecordBatch.from_arrays([pa.array(range(SLOT_BLOBS), pa.int64()), pa.array(parts, pa.binary())], ["blob", "slots"])

        for data, _ in _chunks(batches):
            lines = _Lines(data, shared.value)
            own, place = lines.prefixes()
            slot = lines.tokens[lines.begins[own] + place] >> np.uint64(64 - SLOT_BITS)
            if len(slot):
                held.append((slot << np.uint64(32)) | (lines.c1 >> np.uint64(32))[own])
                size += len(slot)
            if size > _HELD:
                yield blobs()
                held, size = [], 0
        yield blobs()

    def mark(batches):
        first: dict[int, np.ndarray] = {}
        taken: dict[int, np.ndarray] = {}
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            for blob, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blob not in first:
                    first[blob], taken[blob], marks[blob] = np.zeros(width, np.uint32), np.zeros(width, bool), np.zeros(width, bool)
                both = np.frombuffer(data, "<u8")
                slot, line = (both >> np.uint64(32)).astype(np.int64) - blob * width, (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                known = first[blob]
                fresh = ~taken[blob][slot]
                known[slot[fresh]] = line[fresh]
                taken[blob][slot] = True
                marks[blob][slot[known[slot] != line]] = True
        for blob, found in marks.items():
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.int64()), pa.array([np.packbits(found).tobytes()], pa.binary())], ["blob", "slots"])

    schema = "blob bigint, slots binary"
    found = docs.select("text", *KEY).mapInArrow(find, schema).repartition(SLOT_BLOBS, "blob").mapInArrow(mark, schema)
    bits = np.zeros((SLOT_BLOBS, width // 8), np.uint8)
    for row in found.collect():  # SLOT_BLOBS rows, SLOT_BITS bits in all
        bits[row.blob] = np.frombuffer(row.slots, np.uint8)
    return bits.ravel()


_HASHES = ["c1", "c2", "keys.list.element", "prints", "tokens"]
_LINES = "_id bigint, _th bigint, line bigint, c1 bigint, c2 bigint, n bigint, keys array<bigint>, spots array<int>, prints binary, tokens binary"


def document_lines(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Every line with words: the hashes of its token set and its size; and for lines with enough marked prefix tokens
    those of the shortest prefix, their positions, the prints and the whole set as bytes (once for equal lines of a chunk).

    ``shared`` holds the levels of words and the bitmap of slots."""
    names = [*KEY, "line", "c1", "c2", "n", "keys", "spots", "prints", "tokens"]

    def find(batches):
        levels, bits = shared.value
        for data, said in _chunks(batches):
            lines = _Lines(data, levels)
            used = len(lines.used)
            if not used:
                continue
            of, place = lines.prefixes()
            at = lines.begins[of] + place
            slot = (lines.tokens[at] >> np.uint64(64 - SLOT_BITS)).view(np.int64)
            marked = np.flatnonzero((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            count = np.bincount(of[marked], minlength=used)
            marked = marked[place[marked] < prefix_length(lines.n, 1)[of[marked]]]
            of, place, tokens = of[marked], place[marked], lines.tokens[at[marked]]
            early = np.bincount(of, minlength=used)
            firsts = np.array([s[2] for s in said])
            at = np.searchsorted(firsts, lines.used, "right") - 1
            key = np.array([s[:2] for s in said], np.int64).reshape(-1, 2)[at]
            own = lines.used - firsts[at] + np.array([s[3] for s in said])[at]
            # the earliest of equal lines
            order = np.lexsort((own, key[:, 1], key[:, 0], lines.c1))
            fresh = np.zeros(used, bool)
            fresh[order[np.append(True, lines.c1[order][1:] != lines.c1[order][:-1])]] = True
            wanted = fresh & (count >= lines.shared) & (early > 0)
            keys = wanted[of]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(wanted, early, 0))]), pa.int32())
            ends = np.concatenate([[0], np.cumsum(np.where(wanted, 8 * lines.n, 0))]).astype(np.int32)
            whole = lines.tokens[np.repeat(wanted, lines.n)]
            none = np.packbits(wanted, bitorder="little").tobytes()
            width = np.where(wanted, print_bits(lines.n), 0)
            parts = (ends, whole.astype("<u8")), (np.concatenate([[0], np.cumsum(width // 8)]).astype(np.int32), token_prints(whole, lines.n[wanted]))
            sets, prints = (pa.BinaryArray.from_buffers(pa.binary(), used, [pa.py_buffer(none), pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())]) for at, data in parts)
            columns = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in (key[:, 0], key[:, 1], own, lines.c1.view(np.int64), lines.c2().view(np.int64), lines.n)]
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(tokens[keys].view(np.int64), pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(place[keys], pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *lists, prints, sets], names)

    return docs.select("text", *KEY).mapInArrow(find, _LINES)


def print_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the print of a line of ``n`` tokens: the next power of two."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def token_prints(tokens: np.ndarray, n: np.ndarray, finer: int = 1) -> np.ndarray:
    """Bytes of the prints, ``finer`` times as wide, one after the other, of lines of ``n`` tokens each."""
    bits = print_bits(n) * finer
    place = np.repeat(np.cumsum(bits) - bits, n) + (tokens & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=int(bits.sum())).astype(np.uint8) & 1, bitorder="little")


class _Prints:
    """Prints to be compared; the wider one of a pair is folded to the width of the other, at most twice as narrow."""

    def __init__(self, prints: list[bytes]):
        self.words = np.fromiter(map(len, prints), np.int64, len(prints)) // 8
        self.rows = {}
        for words in np.unique(self.words).tolist():
            at, parts = np.zeros(len(prints), np.int64), []
            for times in (1, 2):
                own = np.flatnonzero(self.words == times * words)
                at[own] = sum(map(len, parts)) + np.arange(len(own))
                bits = np.frombuffer(b"".join(prints[i] for i in own.tolist()), "<u8").reshape(-1, times, words)
                parts.append(np.bitwise_xor.reduce(bits, 1))
            self.rows[words] = at, np.concatenate(parts)

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the prints ``x`` and ``y`` differ."""
        out = np.zeros(len(x), np.int64)
        words = np.minimum(self.words[x], self.words[y])
        for w in np.unique(words).tolist():
            at, bits = self.rows[w]
            of = np.flatnonzero(words == w)
            step = max(1, min(_AT_ONCE, _AT_ONCE_BYTES // (8 * w)))
            for start in range(0, len(of), step):
                some = of[start : start + step]
                out[some] = np.bitwise_count(bits[at[x[some]]] ^ bits[at[y[some]]]).sum(1, dtype=np.int64)
        return out


def _may_be_alike(x: int, others: np.ndarray, n: np.ndarray, spot: np.ndarray, prints: _Prints) -> np.ndarray:
    """Those of ``others`` that the length, positional and print filters leave to line ``x`` of a token."""
    m, j = n[others], spot[others]
    needed = -(-3 * (n[x] + m) // 7)
    most = np.minimum(spot[x], j) + 1 + np.minimum(n[x] - spot[x] - 1, m - j - 1)
    fits = (4 * np.minimum(n[x], m) >= 3 * np.maximum(n[x], m)) & (most >= needed)
    others, spare = others[fits], (n[x] + m - 2 * needed)[fits]
    return others[prints.differing(np.full(len(others), x), others) <= spare]


def token_partners(places: list[tuple], n: np.ndarray, spot: np.ndarray, prints: list[bytes], blocks: np.ndarray, partners: int | None, open_lines=None):
    """``(later, earlier, more)``: for each line of a token up to ``partners`` earlier ones (all without a limit),
    earliest first; ``more`` if others are left. With two blocks, only pairs across them count."""
    order = sorted(range(len(places)), key=lambda k: places[k])
    across = len(set(blocks.tolist())) > 1
    rank = np.array(order)
    bits = _Prints(prints)
    for i, x in enumerate(order):
        if open_lines is not None and not open_lines[x]:
            continue
        found, start, width = [], 0, 256
        while start < i and (partners is None or len(found) <= partners):
            others = rank[start : min(i, start + width)]
            start, width = start + width, min(2 * width, 8192)
            if across:
                others = others[blocks[others] != blocks[x]]
            found += _may_be_alike(x, others, n, spot, bits).tolist()
        more = partners is not None and len(found) > partners
        for y in found[:partners]:
            yield x, y, more


def _pairs(entries: DataFrame, sizes: DataFrame, partners: int | None) -> DataFrame:
    """``(later, earlier, more)`` by ``c1``, from ``(key, c1, first, n, spot, prints[, open])`` and the blocks of large tokens."""
    marked = mark_possible(entries, sizes, ["key"])
    large = marked.where("_maybe").drop("_maybe").join(sizes, "key", "left")
    rows = marked.where("NOT _maybe").drop("_maybe").withColumn("blocks", F.lit(None).cast("bigint")).unionByName(large)
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c1"), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
    has_open = "open" in entries.columns

    def match(batches):
        for rows, cuts in _token_groups(batches):
            yield from _matched(rows, cuts, partners, has_open)

    names = ["key", "i", "j", "block", "c1", "first.*", "n", "spot", "prints", "open" if has_open else F.lit(True).alias("open")]
    rows = rows.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(match, "later bigint, earlier bigint, more boolean")


_SMALL = 32


def _token_groups(batches):
    """``(rows, cuts)``: columns of the rows of whole tokens, and where each token begins and the last ends."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        if not len(keys):
            continue
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        last = [c[-1].as_py() for c in kept[-1].columns[:3]] if kept else None
        if last is not None and last != keys[0].tolist():
            yield _columns(kept)
            kept = []
        if not len(ends):
            kept.append(batch)
            continue
        yield _columns([*kept, batch.slice(0, ends[-1])])
        kept = [batch.slice(ends[-1])]
    if kept:
        yield _columns(kept)


def _columns(batches: list[pa.RecordBatch]) -> tuple[dict, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    rows = {name: table.column(name).to_pylist() if name == "prints" else table.column(name).to_numpy() for name in table.column_names}
    keys = np.stack([rows["key"], rows["i"], rows["j"]], 1)
    return rows, np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])


def _matched(rows: dict, cuts: np.ndarray, partners: int | None, has_open: bool):
    """Batches of ``(later, earlier, more)`` of the tokens between the cuts; those of few lines together."""
    sizes = np.diff(cuts)
    out = []
    few = np.flatnonzero((sizes >= 2) & (sizes <= _SMALL))
    if len(few):
        out.append(_small_groups(rows, cuts[few], sizes[few], partners, has_open))
    for g in np.flatnonzero(sizes > _SMALL).tolist():
        a, b = cuts[g], cuts[g + 1]
        places = list(zip(*(rows[c][a:b].tolist() for c in (*KEY, "line"))))
        arrays = rows["n"][a:b], rows["spot"][a:b], rows["prints"][a:b], rows["block"][a:b]
        found = list(token_partners(places, *arrays, partners, rows["open"][a:b] if has_open else None))
        if found:
            x, y, more = (np.array(c) for c in zip(*found))
            out.append((rows["c1"][a + x], rows["c1"][a + y], more))
    out = [o for o in out if len(o[0])]
    if out:
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], ["later", "earlier", "more"])


def _small_groups(rows: dict, starts: np.ndarray, sizes: np.ndarray, partners: int | None, has_open: bool):
    """What ``token_partners`` gives, for many tokens of few lines at once."""
    whole = np.repeat(np.arange(len(starts)), sizes * sizes)
    inside = np.arange(len(whole)) - np.repeat(np.cumsum(sizes * sizes) - sizes * sizes, sizes * sizes)
    x, y = starts[whole] + inside // sizes[whole], starts[whole] + inside % sizes[whole]
    after = np.zeros(len(x), bool)  # the place of y comes before that of x
    tied = np.ones(len(x), bool)
    for c in (*KEY, "line"):
        after |= tied & (rows[c][y] < rows[c][x])
        tied &= rows[c][y] == rows[c][x]
    n, spot = rows["n"], rows["spot"]
    keep = after & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))
    # of two blocks of a token, only pairs across them count
    keep &= (rows["i"][x] == rows["j"][x]) | (rows["block"][x] != rows["block"][y])
    if has_open:
        keep &= rows["open"][x].astype(bool)
    needed = -(-3 * (n[x] + n[y]) // 7)
    keep &= np.minimum(spot[x], spot[y]) + 1 + np.minimum(n[x] - spot[x] - 1, n[y] - spot[y] - 1) >= needed
    x, y, needed = x[keep], y[keep], needed[keep]
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    bits = _Prints([rows["prints"][i] for i in used.tolist()])
    fits = bits.differing(at[: len(x)], at[len(x) :]) <= n[x] + n[y] - 2 * needed
    x, y = x[fits], y[fits]
    order = np.lexsort([rows["line"][y], rows[KEY[1]][y], rows[KEY[0]][y], x])
    x, y = x[order], y[order]
    begins = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    lengths = np.diff(np.append(begins, len(x)))
    place = np.arange(len(x)) - np.repeat(begins, lengths)
    limit = len(x) if partners is None else partners
    chosen = place < limit
    return rows["c1"][x[chosen]], rows["c1"][y[chosen]], np.repeat(lengths > limit, lengths)[chosen]


def _whole_sets(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``(c1, c2, tokens)`` of the token sets ``(c1, c2, _id, _th, line)``, fetched from their first lines."""
    wanted = materialize(wanted, "wanted-lines")
    place = [*KEY, "line"]
    stored = possible_partners(lines.where("tokens IS NOT NULL").select(*place, "tokens"), wanted, place)
    # repeated rows of a document repeat its lines
    return materialize(stored.join(wanted, place).groupBy("c1", "c2").agg(F.max("tokens").alias("tokens")), "wanted-sets")


def _with_fine_prints(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """The entries with prints ``FINER`` times as wide."""

    def widen(batches):
        for batch in batches:
            prints = [token_prints(x := np.frombuffer(t, "<u8"), np.array([len(x)]), FINER).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.binary())], ["c1", "c2", "prints"])

    wanted = entries.groupBy("c1", "c2").agg(F.first("first").alias("first")).select("c1", "c2", "first.*")
    fine = _whole_sets(wanted, lines).mapInArrow(widen, "c1 bigint, c2 bigint, prints binary")
    return entries.drop("prints").join(fine, ["c1", "c2"])


def _verified(pairs: DataFrame, sets: DataFrame, lines: DataFrame) -> DataFrame:
    """``(later, c2, alike, more)`` of each pair, judged on the whole sets, which are fetched for lines in pairs only."""
    both = pairs.select(F.explode(F.array("later", "earlier")).alias("c1")).distinct()
    whole = _whole_sets(both.join(sets.select("c1", "c2", "first.*"), "c1"), lines)
    one = whole.select(F.col("c1").alias("later"), "c2", F.col("tokens").alias("a"))
    other = whole.select(F.col("c1").alias("earlier"), F.col("tokens").alias("b"))
    both = pairs.join(one, "later")
    # one line may be the earlier partner of very many
    both = salted_join(both, other, ["earlier"], heavy_keys(pairs, "earlier"), "earlier", F.col("later"))

    def judge(batches):
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(4 * common >= 3 * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(alike, pa.bool_())], ["later", "c2", "more", "alike"])

    return both.select("later", "c2", "more", "a", "b").mapInArrow(judge, "later bigint, c2 bigint, more boolean, alike boolean")


def _with_matches(sets: DataFrame, lines: DataFrame, block: int, partners: int) -> DataFrame:
    """``(c1, c2)`` of the token sets that have an earlier alike one."""
    entries = sets.select("c1", "c2", "first", "n", "prints", F.explode(F.arrays_zip("keys", "spots")).alias("_k"))
    entries = entries.select("c1", "c2", "first", "n", "prints", F.col("_k.keys").alias("key"), F.col("_k.spots").alias("spot"))
    sizes = sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    sizes = materialize(sizes.select("key", F.ceil(F.col("_n") / block).cast("bigint").alias("blocks")), "large-tokens")

    # one partner of each line first: what passes the filters nearly always is alike
    judged = materialize(_verified(_one_pair_each(_pairs(entries, sizes, partners)), sets, lines), "line-verdicts")
    found = [judged.where("alike").select(F.col("later").alias("c1"), "c2")]
    # lines whose pair did not hold look again, by finer prints: once more at one partner, at last at all that are left
    for limit in (partners, None):
        open_lines = materialize(judged.where("more AND NOT alike").select(F.col("later").alias("c1"), F.lit(True).alias("open")).distinct(), "open-lines")
        if open_lines.isEmpty():
            break
        # only tokens of these lines matter: few of all entries
        open_keys = possible_partners(sets.select("c1", "keys"), open_lines, ["c1"]).join(open_lines, "c1").select(F.explode("keys").alias("key"))
        again = possible_partners(entries, open_keys, ["key"])
        again = again.join(open_lines, "c1", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        pairs = _pairs(_with_fine_prints(materialize(again, "open-entries"), lines), sizes, limit)
        pairs = materialize(pairs.groupBy("later", "earlier").agg(F.max("more").alias("more")), "line-pairs") if limit is None else _one_pair_each(pairs)
        judged = materialize(_verified(pairs, sets, lines), "line-verdicts")
        found.append(judged.where("alike").select(F.col("later").alias("c1"), "c2"))
    return reduce(DataFrame.unionByName, found).distinct() if len(found) > 1 else found[0]


def _one_pair_each(pairs: DataFrame) -> DataFrame:
    """One of the pairs of each line; ``more`` if it has others."""
    pairs = pairs.groupBy("later").agg(F.min("earlier").alias("earlier"), F.max(F.col("more")).alias("more"), F.max("earlier").alias("_most"))
    return materialize(pairs.select("later", "earlier", (F.col("more") | (F.col("earlier") != F.col("_most"))).alias("more")), "line-pairs")


def repeated_lines(docs: DataFrame, block: int = BLOCK, partners: int = PARTNERS) -> DataFrame:
    """``(_id, _th, lines array<bigint>)``: numbers of the lines to remove of each document that has any."""
    levels = word_levels(docs)
    shared = docs.sparkSession.sparkContext.broadcast((levels, shared_slots(docs, levels)))
    lines = materialize(document_lines(docs, shared), "lines", hashes=_HASHES)
    shared.unpersist()  # the executors' copies aren't needed beside the joins
    first = F.min(F.struct(*KEY, "line")).alias("first")
    sets = lines.where("tokens IS NOT NULL").groupBy("c1", "c2").agg(first, *[F.max(c).alias(c) for c in ("n", "keys", "spots", "prints")])
    matched = _with_matches(materialize(sets, "line-sets", hashes=_HASHES), lines, block, partners)

    again = lines.groupBy("c1", "c2").agg(first, F.count("*").alias("times")).where("times > 1").select("c1", "c2", "first", F.lit(False).alias("all"))
    marks = matched.withColumn("all", F.lit(True)).withColumn("first", F.lit(None).cast(again.schema["first"].dataType))
    marks = again.unionByName(marks, allowMissingColumns=True).groupBy("c1", "c2").agg(F.max("all").alias("all"), F.max("first").alias("first"))
    marks = materialize(marks, "line-marks")
    some = possible_partners(lines.select(*KEY, "line", "c1", "c2"), marks, ["c1"])
    hit = salted_join(some, marks, ["c1", "c2"], heavy_keys(some, "c1"), "c1", F.struct(*KEY, "line"))
    later = F.col("all") | (F.struct(*KEY, "line") != F.col("first"))
    return hit.where(later).groupBy(*KEY).agg(F.collect_set("line").alias("lines"))


def without_lines(text: str, removed: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in removed)


def drop_repeated_lines(docs: DataFrame, block: int = BLOCK, partners: int = PARTNERS) -> DataFrame:
    """All columns, with the removed lines taken out of ``text`` and ``n_chars`` (if there) brought up to date."""
    removed = materialize(repeated_lines(keyed(docs), block, partners), "removed-lines")
    marked = mark_possible(wrapped(docs), removed, KEY)
    untouched = marked.where("NOT _maybe").select("_row.*")
    numbers = "_lines"
    while numbers in docs.columns:
        numbers += "_"
    changed = marked.where("_maybe").join(removed, KEY, "left").select("_row.*", F.col("lines").alias(numbers))
    at, last = docs.columns.index("text"), len(docs.columns)
    fields = docs.schema

    def cut(batches):
        for batch in few_rows(batches):
            texts, stay = [], []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
                left = without_lines(text, set(lines)) if lines else text
                texts.append(left)
                stay.append(not lines or bool(left.encode("utf-8", "surrogatepass").split()))
            columns = [batch.column(i) for i in range(last)]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in fields.names:
                k = fields.names.index("n_chars")
                sizes = [len(t) if lines else n for t, lines, n in zip(texts, batch.column(last).to_pylist(), columns[k].to_pylist())]
                columns[k] = pa.array(sizes, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, fields.names).filter(pa.array(stay, pa.bool_()))

    return untouched.unionByName(changed.mapInArrow(cut, fields))
