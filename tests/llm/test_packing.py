import random
import zlib
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from rarespark.llm.packing import difference_partition, pack_documents, pack_sizes, piece_rows
from tests.llm.odd import ROWS, no_documents, odd_documents, text_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_differencing_uses_every_item_once_and_balances():
    draw = random.Random(1)
    for windows in (1, 2, 3, 10, 40):
        sizes = [draw.randint(1, 512) for _ in range(windows * 8)]
        parts = difference_partition(sizes, windows)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert len(parts) == windows and max(sums) - min(sums) <= 60


def test_two_way_differencing_by_hand():
    # 8 - 7 = 1, 6 - 5 = 1, 4: 4 - 1 = 3, 3 - 1 = 2
    parts = difference_partition([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


def test_window_count_rises_when_capacity_is_exceeded():
    packed = pack_sizes([6, 6, 6], 10)  # two windows would do for the sum
    assert len(packed) == 3 and pack_sizes([], 10) == []


def check(rows, got, window=2048):
    tokenizer = Tokenizer.from_file(PATH)
    left = {}
    for row in rows:
        ids = array("I", tokenizer.encode(text_of(row), add_special_tokens=False).ids + [1]).tobytes()
        left.setdefault((row[0], len(ids) // 4), []).append(ids)
    seen, ends = {}, {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        choices = left[r.doc_id, r.doc_tokens]
        assert any(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for ids in choices)
        seen.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert max(ends.values()) <= window
    for key, texts in left.items():
        covered = sorted(p for start, length in seen[key] for p in range(start, start + length))
        assert covered == sorted(list(range(key[1])) * len(texts))
    assert set(seen) == set(left)


def test_every_id_lies_in_one_piece(spark):
    got = piece_rows(pack_documents(odd_documents(spark), PATH)).collect()
    check(ROWS, got)


def test_padding_is_small(spark):
    df = odd_documents(spark, 3)
    sequences = pack_documents(df.coalesce(1), PATH).collect()
    used, padded = sum(s.n_tokens for s in sequences), sum(s.padded_to for s in sequences)
    assert used <= padded <= 1.01 * used + 2048


def test_small_windows_and_empty_table(spark):
    got = piece_rows(pack_documents(odd_documents(spark), PATH, window=64, piece=16, group_windows=8)).collect()
    check(ROWS, got, 64)
    assert pack_documents(no_documents(spark), PATH).count() == 0
