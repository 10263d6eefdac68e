import hashlib
import random
from collections import Counter

import pytest

from rarespark.llm.repeats import remove_repeats, repeated_windows, suffix_array
from tests.llm.odd import ROWS, no_documents, odd_documents, text_of


def test_suffix_array_against_sorting():
    draw = random.Random(1)
    for trial in range(300):
        data = bytes(draw.choice(b"ab" if trial % 2 else b"abcdef") for _ in range(draw.randint(0, 60)))
        data = b"a" * draw.randint(0, 40) * (trial % 7 == 0) + data
        assert suffix_array(data, 128).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_windows_across_pieces_do_not_count():
    flags = [f.tolist() for f, _ in repeated_windows([b"abcdefgh", b"ghabcdxx"], 4)]
    assert flags == [[True, False, False, False, False], [False, False, True, False, False]]


def brute(rows, length):
    texts = [(r[0], text_of(r).encode()) for r in rows]
    seen = Counter(d[p : p + length] for _, d in texts for p in range(len(d) - length + 1))
    out = Counter()
    for key, data in texts:
        marked = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] > 1:
                marked[p : p + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(marked) if x and not (i and marked[i - 1]))
        kept = bytes(c for c, x in zip(data, marked) if not x)
        out[key, len(data), sum(marked), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def answers(df, *args):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(df, *args).collect())


def family(draw):
    base = ["".join(draw.choice("abcdefgh ") for _ in range(1500)) for _ in range(4)]
    rows = []
    for i in range(100):
        letters = list(draw.choice(base)[draw.randint(0, 300) :][: draw.randint(100, 1200)])
        for _ in range(draw.randint(0, 4)):
            letters[draw.randrange(len(letters))] = draw.choice("xyzé")
        rows.append((i, "".join(letters)))
    return rows + [(200, "a" * 1000), (201, "a" * 150), (202, "ab" * 300), (204, "a" * 200), (205, base[0][:200] + "Q" + base[0][:200])]


@pytest.mark.parametrize("part_segments", [2000, 3])
def test_against_brute_force(spark, part_segments):
    rows = family(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert answers(df, 200, part_segments) == brute(rows, 200)


def test_odd_rows(spark):
    rows = [r[:2] for r in ROWS if r[0] != 6] + [(6, ROWS[5][1][:4000])]
    df = odd_documents(spark).where("doc_id IS NULL OR doc_id <> 6").select("doc_id", "text")
    df = df.union(spark.createDataFrame(rows[-1:], "doc_id bigint, text string")).selectExpr("*", "1 AS _id", "2 AS seg", "3 AS spans")
    assert answers(df, 40) == brute(rows, 40)
    assert remove_repeats(no_documents(spark)).count() == 0
