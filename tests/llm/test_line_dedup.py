import random
import re

import numpy as np
import pytest

from rarespark.llm.line_dedup import _matched, _Prints, drop_repeated_lines, print_bits, token_partners, token_prints
from tests.llm.odd import ROWS, no_documents, odd_documents

WORDS = [f"w{i}" for i in range(400)]


def tokens(line):
    words = re.findall(rb"[^\x20\t-\r]+", line.encode().lower())
    if not words:
        return None
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def alike(a, b):
    return 4 * len(a & b) >= 3 * len(a | b)


def brute(rows):
    """{doc_id: text}; ids are distinct here."""
    earlier, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            own = tokens(line)
            if own is None or not any(alike(own, other) for other in earlier):
                kept.append(line)
            if own is not None:
                earlier.append(own)
        left = "\n".join(kept)
        if text is None or left == text or left.split():
            out[doc_id] = None if text is None else left
    return out


def as_print(tokens):
    return token_prints(np.array(tokens, np.uint64), np.array([len(tokens)])).tobytes()


def lines_with_edits(draw):
    base = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 40))) for _ in range(20)]
    rows = []
    for d in range(100):
        lines = []
        for _ in range(draw.randint(0, 6)):
            words = draw.choice(base).split()
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            lines.append(" ".join(words))
        rows.append((d, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, " \n\n "), (503, "A b\na B\n")]


@pytest.mark.parametrize("block", [1024, 4])
def test_against_brute_force(spark, block):
    rows = lines_with_edits(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(df, block).collect()} == brute(rows)


def test_prints_differ_in_no_more_bits_than_sets_in_tokens():
    draw = random.Random(7)
    base = [draw.getrandbits(64) for _ in range(300)]
    sets = [set(draw.sample(base, draw.randint(90, 250))) | {draw.getrandbits(64)} for _ in range(60)]
    n = np.array([len(s) for s in sets])
    together = token_prints(np.array([t for s in sets for t in s], np.uint64), n)
    cuts = np.cumsum(print_bits(n) // 8)[:-1]
    prints = [p.tobytes() for p in np.split(together, cuts)]
    assert prints == [as_print(list(s)) for s in sets] and {len(p) for p in prints} == {16, 32}
    x, y = (a.ravel() for a in np.meshgrid(range(60), range(60)))
    for i, j, differing in zip(x.tolist(), y.tolist(), _Prints(prints).differing(x, y).tolist()):
        width = 8 * min(len(prints[i]), len(prints[j]))
        odd = {b for b in range(width) if sum(t % width == b for t in sets[i] ^ sets[j]) % 2}
        assert differing == len(odd) <= len(sets[i] ^ sets[j])


@pytest.mark.parametrize("partners", [None, 1])
def test_partners_of_a_token_against_brute_force(partners):
    """No alike earlier line is ruled out; lines that share their first token, in another order than their places."""
    draw = random.Random(4)
    lines = [sorted(draw.sample(range(1, 30), draw.randint(2, 14)) + [0]) for _ in range(200)]
    places = [(i, 0, 0) for i in draw.sample(range(200), 200)]
    n, prints = np.array([len(x) for x in lines]), [as_print(x) for x in lines]
    found = {}
    for later, earlier, more in token_partners(places, n, np.zeros(200, int), prints, np.zeros(200, int), partners):
        found.setdefault(later, []).append((earlier, more))
    for i in range(200):
        want = sorted((j for j in range(200) if places[j] < places[i] and alike(set(lines[i]), set(lines[j]))), key=lambda j: places[j])
        got = found.get(i, [])
        assert [j for j, _ in got] == (want if partners is None else want[:1])
        assert all(more == (partners is not None and len(want) > 1) for _, more in got)


def test_tokens_of_few_lines_together_are_like_each_alone():
    draw = random.Random(5)
    rows = {c: [] for c in ("_id", "_th", "line", "c1", "n", "spot", "prints", "block", "open")}
    cuts = [0]
    for _ in range(60):
        for _ in range(draw.choice([1, 2, 3, 9, 30])):
            tokens = draw.sample(range(1, 12), draw.randint(2, 10))
            values = (draw.randint(0, 5), draw.randint(0, 1), len(rows["_id"]), draw.getrandbits(40), len(tokens), draw.randint(0, 1), as_print(tokens), 0, draw.random() < 0.5)
            for c, v in zip(rows, values):
                rows[c].append(v)
        cuts.append(len(rows["_id"]))
    rows = {c: v if c == "prints" else np.array(v) for c, v in rows.items()}
    rows["i"] = rows["j"] = rows["block"]
    for partners in (None, 1, 3):
        for has_open in (False, True):
            want = []
            for a, b in zip(cuts, cuts[1:]):
                places = list(zip(*(rows[c][a:b].tolist() for c in ("_id", "_th", "line"))))
                arrays = rows["n"][a:b], rows["spot"][a:b], rows["prints"][a:b], rows["block"][a:b]
                for x, y, more in token_partners(places, *arrays, partners, rows["open"][a:b] if has_open else None):
                    want.append((rows["c1"][a + x], rows["c1"][a + y], more))
            got = [tuple(r.values()) for batch in _matched(rows, np.array(cuts), partners, has_open) for r in batch.to_pylist()]
            assert sorted(got) == sorted(want)


def test_one_partner_a_token(spark):
    rows = lines_with_edits(random.Random(6))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(df, 50, 1).collect()} == brute(rows)


def test_a_family_that_is_nearly_alike_makes_few_pairs(spark, monkeypatch):
    """Lines of similarity 0.70 with one another: none goes, and few are compared on the whole sets."""
    from rarespark.llm import line_dedup

    base = [f"b{i}" for i in range(60)]
    lines = [" ".join([*base[: 6 + i % 48], f"own{i}", *base[7 + i % 48 :]]) for i in range(144)]
    judged, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *more: judged.append(pairs.count()) or verified(pairs, *more))
    rows = [*enumerate(lines), (200, lines[7]), (201, lines[9] + " and")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(df).collect()} == brute(rows)
    assert 0 < sum(judged) < 6 * len(lines)


def test_long_text_in_chunks(spark, monkeypatch):
    from rarespark.llm import line_dedup

    lines = [f"line {i} has its own words {i * 7} and {i * 11} to tell" for i in range(300)]
    monkeypatch.setattr(line_dedup, "_CHUNK", 500)
    chunks = list(line_dedup._chunks([spark.createDataFrame([("\n".join(lines), 1, 2)], "t string, a bigint, b bigint").toArrow().to_batches()[0]]))
    assert b"\n".join(c[0] for c in chunks) == "\n".join(lines).encode()
    assert [(s[3], s[4]) for c in chunks for s in c[1]][0][0] == 0 and sum(s[4] for c in chunks for s in c[1]) == 300


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = drop_repeated_lines(df)
    assert got.columns == df.columns and drop_repeated_lines(no_documents(spark)).count() == 0
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))
    twice = df.where("doc_id = 1").union(df.where("doc_id = 1").selectExpr("doc_id + 100", *[f"`{c}`" for c in df.columns[1:]]))
    assert [r.doc_id for r in drop_repeated_lines(twice).collect()] == [1]
    assert len(ROWS) == df.count()
