"""Quality verdicts by weak supervision instead of rules that must all pass.

Each rule votes good, votes bad or abstains. Documents with the same votes are
alike, so the corpus is counted by vote pattern (at most ``3 ** len(RULES)``
patterns) and expectation-maximisation on these counts estimates, for a good and
for a bad document, how often each rule votes which way when it votes, and
the share of good documents. The posterior probability of a pattern decides.
A rule may vote bad seldom; what counts is how much more often it does so on bad
documents, and the estimates are held to that side.

Null text has no words. A text with fewer than ``BASE_WORDS`` words, or
with more than half of them inside repeated three-word windows, fails at once.
Repeated rows get the same verdict each; an empty table gives no rows; in
``keep_good_documents`` all columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.rows import few_rows
from rarespark.session import materialize

BASE_WORDS = 50
WINDOW = 3
KEEP_FROM = 0.5
ROUNDS = 200

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", "u1")


@dataclass(frozen=True)
class Rule:
    """Bad from ``bad`` on, good up to ``good``, else no vote. ``bad < good``: the other way round."""

    measure: str
    good: float
    bad: float

    def vote(self, value: float | None) -> int:
        if value is None:
            return 2
        if self.bad > self.good:
            return 0 if value >= self.bad else 1 if value <= self.good else 2
        return 0 if value <= self.bad else 1 if value >= self.good else 2


RULES = [
    Rule("n_words", good=100, bad=60),
    Rule("mean_word_chars", good=9.0, bad=14.0),
    Rule("symbols_per_word", good=0.02, bad=0.1),
    Rule("repeated_words_share", good=0.1, bad=0.3),
    Rule("duplicate_lines_share", good=0.05, bad=0.3),
    Rule("capitals_share", good=0.15, bad=0.3),
    Rule("exclamations_per_word", good=0.05, bad=0.2),
    Rule("letters_share", good=0.92, bad=0.75),
]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    inside = covered = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + WINDOW - max(i, inside)
            inside = i + WINDOW
    return covered


def measure(text: str) -> dict[str, float | None]:
    words = _WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1"), minlength=256)
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    chars = sum(map(len, words))
    symbols = int(counts[_SYMBOLS].sum())
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    letters = capitals + small + int(counts[0xC2:].sum())
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": repeats,
        "mean_word_chars": chars / n if n else None,
        "symbols_per_word": symbols / n if n else None,
        "repeated_words_share": repeats / n if n else None,
        "duplicate_lines_share": duplicates / len(lines) if len(lines) > 1 else None,
        "capitals_share": capitals / (capitals + small) if capitals + small else None,
        "exclamations_per_word": int(counts[33]) / n if n else None,
        "letters_share": letters / chars if chars else None,
    }


def vote_pattern(measures: dict, rules: list[Rule]) -> int:
    """Votes as digits in base 3: 0 bad, 1 good, 2 none."""
    pattern = 0
    for rule in reversed(rules):
        pattern = 3 * pattern + rule.vote(measures[rule.measure])
    return pattern


def base_failed(measures: dict) -> bool:
    return measures["n_words"] < BASE_WORDS or 100 * measures["n_repeat_words"] > 50 * measures["n_words"]


STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, pattern bigint"
_STATS = [f.split()[0] for f in STATS.split(", ")]


def document_stats(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``(doc_id, <counts>, base_failed, pattern)`` of every document."""

    def stats(batches):
        for batch in few_rows(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                found = measure(text)
                rows.append([found[c] for c in _STATS[:5]] + [base_failed(found), vote_pattern(found, rules)])
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_STATS])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(stats, f"doc_id bigint, {STATS}")


@dataclass(frozen=True)
class LabelModel:
    """``bad_vote[y, r]``: how often rule r votes bad on documents of class y (1 good), if it votes."""

    rules: int
    share_good: float
    bad_vote: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        votes = _votes(patterns, self.rules)
        logs = np.log(np.array([1 - self.share_good, self.share_good]))[:, None] + np.zeros(len(patterns))
        for y in (0, 1):
            p = self.bad_vote[y]
            logs[y] += np.where(votes == 0, np.log(p), np.where(votes == 1, np.log1p(-p), 0.0)).sum(axis=1)
        top = logs.max(axis=0)
        e = np.exp(logs - top)
        return e[1] / e.sum(axis=0)

    def accuracies(self) -> np.ndarray:
        """Share of right votes of each rule."""
        return self.share_good * (1 - self.bad_vote[1]) + (1 - self.share_good) * self.bad_vote[0]


def _votes(patterns: np.ndarray, rules: int) -> np.ndarray:
    return (np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(rules)[None, :]) % 3


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rules: int) -> LabelModel:
    """Expectation-maximisation on counts by pattern. One pseudo-vote of each kind
    keeps estimates inside (0, 1); with no documents they are the starting values."""
    model = LabelModel(rules, 0.8, np.array([[0.3] * rules, [0.02] * rules]))
    if not len(patterns):
        return model
    votes, counts = _votes(patterns, rules), np.asarray(counts, float)
    for _ in range(ROUNDS):
        good = model.posterior(patterns)
        rates = np.empty((2, rules))
        for y, weight in ((0, counts * (1 - good)), (1, counts * good)):
            bad = (weight[:, None] * (votes == 0)).sum(axis=0)
            cast = (weight[:, None] * (votes != 2)).sum(axis=0)
            rates[y] = (bad + 1) / (cast + 2) if y == 0 else (bad + 0.1) / (cast + 10)
        # a vote for bad must not speak for good
        rates[0] = np.maximum(rates[0], rates[1])
        share = (counts @ good + 8) / (counts.sum() + 10)
        step = abs(share - model.share_good) + np.abs(rates - model.bad_vote).max()
        model = LabelModel(rules, float(share), rates)
        if step < 1e-9:
            break
    return model


def fit_on(stats: DataFrame, rules: list[Rule] = RULES) -> tuple[LabelModel, dict[int, float]]:
    """The model and the posterior of each pattern that occurs.

    Documents that fail the base are left out of the fit. What is collected has a
    row per pattern, so its size is bounded by the rules."""
    rows = stats.groupBy("pattern").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n")).collect()
    patterns = np.array(sorted((r.pattern for r in rows)), np.int64)
    counts = {r.pattern: r.n for r in rows}
    model = fit_label_model(patterns, np.array([counts[p] for p in patterns.tolist()]), len(rules))
    return model, dict(zip(patterns.tolist(), model.posterior(patterns).tolist()))


def judge_documents(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Counts, ``base_failed``, posterior ``quality`` and ``kept`` of every document."""
    stats = materialize(document_stats(docs, rules), "quality-stats")
    _, posterior = fit_on(stats, rules)
    spark = docs.sparkSession
    table = spark.createDataFrame([(p, q) for p, q in posterior.items()], "pattern bigint, quality double")
    # at most 3 ** len(rules) rows
    judged = stats.join(F.broadcast(table), "pattern", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def keep_good_documents(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The documents that ``judge_documents`` keeps, with all their columns, without
    moving a text: the votes are counted in a first pass and taken again in a second."""
    _, posterior = fit_on(document_stats(docs, rules), rules)
    good = {pattern for pattern, quality in posterior.items() if quality >= KEEP_FROM}
    at = docs.columns.index("text")

    def keep(batches):
        for batch in few_rows(batches):
            mask = []
            for text in batch.column(at).to_pylist():
                found = measure(text or "")
                mask.append(not base_failed(found) and vote_pattern(found, rules) in good)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
