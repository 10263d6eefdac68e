import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rarespark.llm.mixing import POOL, mix_documents, mix_slots, pfair_period, whole_weights
from tests.llm.odd import no_documents, odd_documents


@pytest.mark.parametrize("seed", range(8))
def test_deviation_stays_below_a_block(seed):
    draw = random.Random(seed)
    units = whole_weights({f"s{i}": draw.random() ** 3 + 1e-4 for i in range(draw.randint(1, 25))}, 1000)
    assert sum(units.values()) == 1000
    count = Counter()
    for t, source in enumerate(pfair_period(units) * 2, 1):
        count[source] += 1
        assert all(abs(1000 * count[s] - w * t) < 1000 for s, w in units.items())


def corpus(spark):
    draw = random.Random(2)
    rows = [(i, "x" * draw.randint(1, 90), draw.choice(["big"] * 6 + ["mid"] * 3 + ["low"])) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows


def test_every_document_is_placed_and_prefixes_keep_the_weights(spark):
    df, rows = corpus(spark)
    weights = {"big": 0.5, "mid": 0.3, "low": 0.2}
    got = mix_slots(df, weights, block_chars=500).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    sources = {}
    for r in got:
        assert sources.setdefault(r.slot, r.stream) == r.stream
    end = max(sources) + 1
    assert sorted(sources) == list(range(end))
    count = Counter()
    for t in range(end):
        count[sources[t]] += 1
        assert all(abs(count[s] - w * (t + 1)) < 1 for s, w in weights.items())
    # the scarcest source for its weight goes round, the one that decides the length doesn't
    assert any(r.epoch > 0 for r in got) and any(all(r.epoch == 0 for r in got if r.stream == s) for s in weights)


def test_blocks_are_full(spark):
    df, rows = corpus(spark)
    size = {r[0]: len(r[1]) for r in rows}
    chars = Counter()
    for r in mix_slots(df, block_chars=500).where("epoch = 0").collect():
        chars[r.stream, r.block] += size[r.doc_id]
    last = {s: max(b for t, b in chars if t == s) for s, _ in chars}
    assert all(abs(n - 500) < 90 for (s, b), n in chars.items() if b < last[s])


def test_small_sources_share_a_stream(spark):
    rows = [(i, "x" * 100, f"tiny{i}") for i in range(200)] + [(1000, "y" * 30_000, "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    streams = {r.stream for r in mix_slots(df, block_chars=1000).select("stream").distinct().collect()}
    assert streams == {"big", POOL}


def characters(rows, got):
    """Characters of each source up to the end of each slot, and the last slot's number."""
    size = {r[0]: len(r[1]) for r in rows}
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, Counter())[r.source] += size[r.doc_id]
    total, out = Counter(), []
    for slot in range(max(by_slot) + 1):
        total.update(by_slot.get(slot, {}))
        out.append(Counter(total))
    return out


def test_pooled_sources_keep_their_own_weights(spark):
    draw = random.Random(4)
    names = [f"s{k:03d}" for k in range(100)]
    rows = [(i, "x" * draw.randint(20, 90), names[i % 100 if i < 6000 else i % 20]) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text)
    total = sum(sizes.values())
    assert max(sizes.values()) * 64 < total or len([s for s in names if sizes[s] * 64 < total]) > 70
    pull = {s: (n / total) ** 0.9 for s, n in sizes.items()}
    got = mix_slots(df, block_chars=2000).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    prefixes = characters(rows, got)
    for t in (len(prefixes) // 4, len(prefixes) // 2, len(prefixes) - 1):
        seen = sum(prefixes[t].values())
        assert all(abs(prefixes[t][s] - seen * pull[s] / sum(pull.values())) < 2000 * 0.1 + 90 * 3 for s in names if sizes[s] * 64 < total)


@pytest.mark.parametrize("shares", [{"a": 700, "b": 295, "c": 5}, {"a": 995, "b": 5}, {"a": 500, "b": 500}])
def test_no_large_source_loses_its_stream(spark, shares):
    rows = [(i, "x" * 50, s) for i, s in enumerate(s for s, n in shares.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix_slots(df, block_chars=1000).collect()
    assert {r.source: r.stream for r in got} == {s: s if n > 100 else POOL for s, n in shares.items()}
    pull = {s: (n / 1000) ** 0.9 for s, n in shares.items()}
    last = characters(rows, got)[-1]
    assert all(abs(last[s] / sum(last.values()) - w / sum(pull.values())) < 0.02 for s, w in pull.items())


def test_small_named_source_has_its_weight(spark):
    rows = [(i, "x" * 50, "big" if i < 990 else "low") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix_slots(df, {"big": 0.8, "low": 0.2}, block_chars=1000).collect()
    assert {r.stream for r in got} == {"big", "low"}
    for prefix in characters(rows, got)[50:]:
        assert abs(prefix["low"] / sum(prefix.values()) - 0.2) < 0.03


def test_odd_rows(spark):
    df = odd_documents(spark)
    mixed = mix_documents(df)
    assert mixed.columns == df.columns
    count = lambda d: d.groupBy("doc_id", F.xxhash64("text").alias("t")).count().collect()
    before = {(r.doc_id, r.t): r["count"] for r in count(df)}
    after = {(r.doc_id, r.t): r["count"] for r in count(mixed)}
    assert before.keys() == after.keys() and all(after[k] >= before[k] for k in before)
    assert mix_documents(no_documents(spark)).count() == 0 and mix_slots(no_documents(spark)).count() == 0
    by_text = lambda d: {tuple(r) for r in d.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).count().collect()}
    assert by_text(mixed) == {tuple(r) for r in mix_slots(df).groupBy("doc_id", "_th").count().collect()}


@pytest.mark.parametrize("block_chars", [1 << 18, 40])
def test_repeated_rows_are_placed_each(spark, block_chars):
    """Six equal rows, also over the borders of blocks; rows of one id and text in two sources keep their own slots."""
    rows = [(1, "same text here", "a")] * 6 + [(1, "same text here", "b")] * 2 + [(i, "other text now", "ab"[i % 2]) for i in range(2, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = Counter((r.doc_id, r.source) for r in mix_documents(df, {"a": 0.6, "b": 0.4}, block_chars).collect())
    assert mixed == Counter((r.doc_id, r.source) for r in mix_slots(df, {"a": 0.6, "b": 0.4}, block_chars).collect())
    first = Counter((r.doc_id, r.source) for r in mix_slots(df, {"a": 0.6, "b": 0.4}, block_chars).where("epoch = 0").collect())
    assert first == Counter((d, s) for d, _, s in rows)
