"""Quality rules: a decision list learned by sequential covering.

Statistics of a text are column expressions. From a bounded sample of labelled
rows the learner grows one rule at a time: it adds the threshold test that gains most
information until the rule covers no good text, prunes tests from the end on rows
kept apart for that, and removes what the rule covers. The list is emitted as
ordered conditional expressions that Spark evaluates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.llm.text import (
    LOWER, SPACES, UPPER, blank_if_null, chars_in, fenced, split_words,
)

SYMBOLS = "#*$%&|<>"
#: Labelled rows that a list is learned from, at most.
SAMPLE_ROWS = 20_000
#: Candidate thresholds of one statistic.
CUTS = 48
MAX_TESTS, MAX_RULES, MIN_COVER = 3, 16, 8
FEATURES = (
    "n_words", "word_length", "symbols_per_word", "duplicate_lines", "repeated_words",
    "upper_share", "letter_share", "marks_per_word", "digit_share",
)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Test, ...]


def _window_hashes(words: Column, width: int) -> Column:
    n = F.size(words)
    heads = F.when(n >= width, F.slice(words, 1, F.greatest(n - width + 1, F.lit(1))))
    return F.transform(
        heads, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width)))
    )


def text_statistics(documents: DataFrame, width: int = 5) -> DataFrame:
    """``documents`` with the counts and shares of FEATURES for its column ``text``.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in
    ``width``-word windows found twice or more) and the shares. A missing text counts
    as empty; shares of an empty text are 0. Whole texts are read, in time that grows
    with n log n of a text's words at worst. Rows are handled one by one; input columns
    with the name of a new one are replaced.
    """
    new = {*FEATURES, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    kept = [c for c in documents.columns if c not in new]
    text = blank_if_null(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    split = documents.select(
        *kept, text.alias("__text"), fenced(split_words(text)).alias("__words"),
        lines.alias("__lines"),
    )
    hashed = split.withColumn("__windows", fenced(_window_hashes(F.col("__words"), width)))
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    sort = F.array_sort(
        F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    # Windows that occur again: equal neighbours in the order of the hashes.
    ordered = hashed.select(
        *kept, "__text", F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        fenced(F.when(repeated, sort)).alias("__sorted"),
    )
    again = F.filter(
        "__sorted",
        lambda e, k: (e["h"] == F.get("__sorted", k - 1)["h"])
        | (e["h"] == F.get("__sorted", k + 1)["h"]),
    )
    starts = ordered.withColumn(
        "__starts", fenced(F.array_sort(F.transform(again, lambda e: e["i"])))
    ).drop("__sorted")
    # A window adds the words up to the next repeated window, or all of its own.
    adds = F.transform(
        "__starts",
        lambda at, k: F.least(F.lit(width), F.coalesce(F.get("__starts", k + 1) - at, F.lit(width))),
    )
    counted = starts.select(
        *kept, "__text", "n_words", "__n_lines", "n_dup_lines",
        F.coalesce(F.aggregate(adds, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
        .alias("n_repeat_words"),
        F.length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
        chars_in(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        chars_in(F.col("__text"), UPPER).alias("__upper"),
        chars_in(F.col("__text"), LOWER).alias("__lower"),
        chars_in(F.col("__text"), "!?").alias("__marks"),
        chars_in(F.col("__text"), "0123456789").alias("__digits"),
    )

    def share(part: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), of.cast("double")), F.lit(0.0))

    words, chars = F.col("n_words"), F.col("word_chars")
    letters = F.col("__upper") + F.col("__lower")
    return counted.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(chars, words).alias("word_length"),
        share(F.col("n_symbols"), words).alias("symbols_per_word"),
        share(F.col("n_dup_lines"), F.col("__n_lines")).alias("duplicate_lines"),
        share(F.col("n_repeat_words"), words).alias("repeated_words"),
        share(F.col("__upper"), letters).alias("upper_share"),
        share(letters, chars).alias("letter_share"),
        share(F.col("__marks"), words).alias("marks_per_word"),
        share(F.col("__digits"), chars).alias("digit_share"),
    )


def _covered(values: dict[str, np.ndarray], tests: Sequence[Test], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for t in tests:
        hit &= values[t.feature] > t.threshold if t.above else values[t.feature] <= t.threshold
    return hit


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the test with the highest information gain until no good row is covered."""
    tests: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < MAX_TESTS and (~bad[inside]).any():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best: tuple[float, Test] | None = None
        for feature in FEATURES:
            v = values[feature][inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS), method="lower"))
            if len(cuts) < 2:
                continue
            order = np.argsort(v, kind="stable")
            below = np.searchsorted(v[order], cuts[:-1], side="right")
            p_below = np.concatenate([[0], np.cumsum(bad[inside][order])])[below]
            for above in (True, False):
                p = p0 - p_below if above else p_below
                total = len(v) - below if above else below
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = p * (np.log2(p / total) - math.log2(p0 / (p0 + n0)))
                gain[(p < MIN_COVER) | ~np.isfinite(gain)] = -1
                at = int(np.argmax(gain))
                if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-9):
                    # Between the two nearest values, to leave room on both sides.
                    middle = float((cuts[at] + v[order][min(below[at], len(v) - 1)]) / 2)
                    best = float(gain[at]), Test(feature, above, middle)
        if best is None:
            break
        tests.append(best[1])
        inside = _covered(values, tests, len(bad))
    return tuple(tests)


def learn_rules(rows: Sequence[Sequence[float]], min_precision: float = 0.9) -> list[Rule]:
    """Rules for bad texts, in order, from rows of (FEATURES..., good 0/1, prune 0/1).

    Rows without a label are to be left out by the caller. A rule joins the list when, pruned,
    it is right for at least ``min_precision`` of what it covers in both halves;
    otherwise learning ends. No rows, or rows of one class, give no rules.
    """
    table = np.asarray(rows, float).reshape(-1, len(FEATURES) + 2)
    bad, prune = table[:, -2] == 0, table[:, -1] == 1
    values = {f: table[:, i] for i, f in enumerate(FEATURES)}
    left = np.ones(len(table), bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, check = left & ~prune, left & prune
        if bad[grow].sum() < MIN_COVER:
            break
        rule = _grow({f: v[grow] for f, v in values.items()}, bad[grow])
        if not rule:
            break

        def worth(tests: Rule, at: np.ndarray = check) -> float:
            hit = _covered(values, tests, len(table)) & at
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / max(p + n, 1)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _covered(values, rule, len(table)) & left
        ok = all(
            (hit & part & bad).sum() >= min_precision * max((hit & part).sum(), 1)
            for part in (~prune, prune)
        )
        if not ok or (hit & bad).sum() < MIN_COVER:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(
    documents: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Learn from the labelled rows of ``documents`` (``labels``: doc_id, quality 0/1).

    At most ``max_rows`` labels are used, those with the smallest hash of their id; their
    statistics (numbers only) are gathered. A quarter is for pruning. Labels that are
    missing, or whose document is, are left out; contradictory ones all count.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__doc"), F.col("quality").cast("int").alias("__good"))
        .dropna()
        .orderBy(F.xxhash64("__doc"), "__good")
        .limit(max_rows)
    )
    # At most max_rows pairs of numbers: small by construction.
    rows = documents.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__doc")
    )
    part = (F.pmod(F.xxhash64(F.col("__doc"), F.lit("prune")), F.lit(4)) == 0).cast("int")
    sample = text_statistics(rows).select(*FEATURES, "__good", part.alias("__prune"))
    return learn_rules(sorted(map(tuple, sample.collect())))


def first_rule(rules: Sequence[Rule]) -> Column:
    """Number of the first rule (from 1) that holds for a row, else 0."""
    number: Column | None = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].expression()
        for test in rule[1:]:
            holds = holds & test.expression()
        number = F.when(holds, k) if number is None else number.when(holds, k)
    return F.lit(0) if number is None else number.otherwise(0)


def judge_quality(
    documents: DataFrame, rules: Sequence[Rule], min_words: int = 10, max_repeated: int = 20
) -> DataFrame:
    """Statistics of every row with ``base_failed``, ``rule`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated`` percent of
    them in repeated windows. ``rule`` is the first rule of the list that rejects the row,
    0 if none does; ``kept`` needs both to pass. Missing values, ties and repeated rows as in
    ``text_statistics``.
    """
    rows = text_statistics(documents)
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")
    )
    kept = [c for c in rows.columns if c not in ("base_failed", "rule", "kept")]
    judged = rows.select(*kept, failed.alias("base_failed"), first_rule(rules).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
