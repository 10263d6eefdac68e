import re
from collections import Counter

import numpy as np

from rarespark.llm.quality import RULES, document_stats, fit_label_model, judge_documents, keep_good_documents, measure, repeated_words
from tests.llm.odd import LONG, no_documents, odd_documents, word


def brute_repeats(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return sum(any(0 <= k <= len(words) - 3 and windows[tuple(words[k : k + 3])] > 1 for k in (i - 2, i - 1, i)) for i in range(len(words)))


def test_counts_against_brute_force():
    draw = np.random.RandomState(0)
    for _ in range(200):
        words = [f"w{k}" for k in draw.randint(0, 6, draw.randint(0, 40))]
        assert repeated_words(words) == brute_repeats(words)
    text = "a#b $é\n\nx y\nx y\n \nx y\x1cz <|> x y\n"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    got = measure(text)
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == 5 and got["n_dup_lines"] == len(lines) - len(set(lines))


def test_em_recovers_accuracies():
    draw = np.random.RandomState(1)
    n, rules = 40_000, 6
    good = draw.rand(n) < 0.7
    bad_vote = np.array([[0.5, 0.3, 0.6, 0.4, 0.25, 0.7], [0.01, 0.02, 0.05, 0.01, 0.03, 0.1]])
    votes = (draw.rand(n, rules) >= np.where(good[:, None], bad_vote[1], bad_vote[0])).astype(int)
    votes[draw.rand(n, rules) < 0.2] = 2
    patterns, counts = np.unique(votes @ 3 ** np.arange(rules), return_counts=True)
    model = fit_label_model(patterns, counts, rules)
    assert abs(model.share_good - 0.7) < 0.03 and np.abs(model.bad_vote - bad_vote).max() < 0.05
    right = (model.posterior(votes @ 3 ** np.arange(rules)) >= 0.5) == good
    assert right.mean() > 0.85 and (np.abs(model.accuracies() - ((0.7 * (1 - bad_vote[1])) + 0.3 * bad_vote[0])) < 0.05).all()


def plain(i):
    return " ".join(word((i * 31 + k * 17) % 1009) for k in range(120))


def test_junk_goes_and_prose_stays(spark):
    prose = [(i, plain(i)) for i in range(300)]
    junk = [(1000 + i, " ".join("BUY!!" if k % 2 else "NOW!!" for k in range(120 + i))) for i in range(30)]
    junk += [(2000 + i, " ".join(word(k) + "###" for k in range(100 + i))) for i in range(30)]
    junk += [(3000 + i, "few words here") for i in range(3)]
    df = spark.createDataFrame(prose + junk, "doc_id bigint, text string")
    kept = {r.doc_id for r in judge_documents(df).where("kept").collect()}
    assert kept == {i for i, _ in prose}
    assert {r.doc_id for r in keep_good_documents(df).collect()} == kept


def test_odd_rows(spark):
    df = odd_documents(spark)
    stats = document_stats(df).collect()
    assert len(stats) == df.count()
    judged = judge_documents(df).collect()
    assert all(r.kept is not None for r in judged) and {r.doc_id for r in judged if r.kept} == {6}
    assert len(LONG.split()) == next(r.n_words for r in judged if r.doc_id == 6)
    kept = keep_good_documents(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [6]
    assert judge_documents(no_documents(spark)).count() == 0 == keep_good_documents(no_documents(spark)).count()
    assert len({r.measure for r in RULES}) == len(RULES)
