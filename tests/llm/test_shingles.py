import random
import tracemalloc

import numpy as np
import pytest

from rarespark.llm.shingles import SHINGLE, chained, word_hashes


def test_equal_words_and_no_others_have_equal_hashes():
    draw = random.Random(3)
    words = {b"a", b"a\0", b"a\0\0", b"\0", b"\0\0"}
    for size in range(1, 80):
        word = bytes(draw.choice(b"abc\0\xc3") for _ in range(size))
        words |= {word, word + b"a", b"a" + word, word[::-1], word[8:] + word[:8], bytes(8) + word}
    words = sorted(words)
    some = [draw.choice(words) for _ in range(5000)]
    data = b"".join(w + bytes(draw.choice(b" \n\t\v\f\r") for _ in range(draw.randint(1, 3))) for w in [*words, *some]).rstrip()
    starts, hashes = word_hashes(data)
    assert [data[s : s + len(w)] for s, w in zip(starts.tolist(), [*words, *some], strict=True)] == [*words, *some]
    of = dict(zip(words, hashes.tolist()))
    assert len(set(of.values())) == len(words)
    assert hashes[len(words) :].tolist() == [of[w] for w in some]


def test_order_of_words_counts():
    h = word_hashes(b"a b a b a a a a b b b a")[1]
    runs = chained(h, SHINGLE, len(h) - SHINGLE + 1)
    assert len(set(runs.tolist())) == len(runs)


@pytest.mark.parametrize("data", [b"", b" ", b"\n \t"])
def test_no_words(data):
    starts, hashes = word_hashes(data)
    assert not len(starts) and not len(hashes)


def test_memory_goes_by_words():
    data = b"several ordinary words of a line\n" * 30_000
    tracemalloc.start()
    hashes = word_hashes(data)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(hashes)) == 6
    assert peak < 16 * len(data)
