import math
import random
import re

import numpy as np
import pytest

from rarespark.llm import lexical
from rarespark.llm.lexical import Chunk, ranked_search, term_counts
from tests.llm.odd import no_documents, odd_documents, text_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    """Rows ``(item_id, rank, doc_id, score)``; a null id comes first."""
    counted = [(d, terms(t)) for d, t in docs]
    counted = [(d, w) for d, w in counted if w]
    total, df = sum(len(w) for _, w in counted), {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(queries):
        scores = []
        for d, w in counted:
            m, score = 10 + 90 * len(w) * len(counted) // total, 0
            for t in set(terms(text)):
                tf = w.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return out


def key(row):
    return tuple((v is not None, v or 0) for v in row)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=key)


def random_texts(draw, n):
    words = [f"Wort{i}" for i in range(30)] + ["the", "of", "é", "日本", "a1"]
    return [(i * 3 + 1, draw.choice([" ", ", ", "\n"]).join(draw.choices(words, range(35, 0, -1), k=draw.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("query_bytes", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, query_bytes):
    draw = random.Random(5)
    docs = random_texts(draw, 400)
    docs += [(d + 10_000, t) for d, t in docs[:50]]  # ties
    queries = [(i, t) for i, (_, t) in enumerate(random_texts(draw, 8))] + [(50, None), (51, "..."), (52, "unseen"), (None, "the wort3")]
    monkeypatch.setattr(lexical, "CHUNK_DOCS", 37)
    got = ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(queries, "item_id bigint, text string"), query_bytes=query_bytes)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert as_rows(got) == sorted(brute(docs, queries, 10), key=key)


def test_few_intervals_are_split(monkeypatch):
    """Most documents are ruled out by bounds and never scored."""
    rng = np.random.default_rng(1)
    n, seen = 4000, []
    lists = [np.sort(rng.choice(n, size, replace=False)) for size in (4000, 900, 40)]
    tfs = [rng.integers(1, 3, len(x)) for x in lists]
    tfs[0][lists[2]] = 3
    chunk = Chunk(np.arange(n), np.full(n, 50), [0, 1, 2], np.array([len(x) for x in lists]), np.concatenate(lists).astype("<i4"), np.concatenate(tfs).astype("<i4"), n, 50 * n)
    inner = chunk._bounds
    monkeypatch.setattr(chunk, "_bounds", lambda a, b, w: seen.append(len(a)) or inner(a, b, w))
    best = chunk.search([0, 1, 2], np.array([10, 800, 4000]), 10, [])
    impact = np.zeros(n, np.int64)
    for w, x, at in zip((10, 800, 4000), lists, np.split(chunk.value, np.cumsum([len(x) for x in lists])[:-1])):
        impact[x] += w * at
    assert best == sorted(((int(s), -i) for i, s in enumerate(impact)), reverse=True)[:10]
    assert sum(seen) < n


def test_terms_in_pieces(monkeypatch):
    text = " ".join(f"Ab{i % 13}é" for i in range(500)) + "x" * 300
    whole = term_counts(text.encode())
    monkeypatch.setattr(lexical, "_PIECE", 64)
    assert term_counts(text.encode()) == whole and whole[1] == len(terms(text))


def test_odd_rows(spark):
    df, queries = odd_documents(spark), [(1, "quick brown same"), (2, "one text É 日本語"), (2, "one text É 日本語"), (3, "word5x5")]
    asked = spark.createDataFrame(queries, "item_id bigint, text string").selectExpr("*", "1 AS item", "2 AS score")
    want = brute([(r.doc_id, text_of((0, r.text))) for r in df.select("doc_id", "text").collect()], queries, 10)
    assert as_rows(ranked_search(df, asked)) == sorted(want, key=key)
    assert ranked_search(no_documents(spark), asked).count() == 0
    assert ranked_search(df, asked.where("item_id = -1")).count() == 0
