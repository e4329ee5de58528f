"""Quality rules learned as a decision list, applied as one ordered Spark expression.

Sequential covering: rules that reject are grown one at a time on labelled statistics. A rule
is a conjunction of thresholds; each next threshold is the one of the highest information gain on
two thirds of the sample, and conditions are cut from its end while that doesn't hurt on the last
third. What a rule covers is taken out before the next one is grown. The list ends
when no rule is precise enough; everything that no rule rejects is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelinekit.llm.statistics import COUNTS, FEATURES, features, labelled_sample, with_statistics

SAMPLE_ROWS = 20_000  # labelled documents that the rules are learned from, at most
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 48  # thresholds tried per statistic, at quantiles
MIN_PRECISION = 0.95  # on the part held out for pruning
MIN_WORDS = 50
REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: np.ndarray) -> np.ndarray:
        values = table[:, FEATURES.index(self.feature)]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, by_name: dict[str, Column]) -> Column:
        value = by_name[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: np.ndarray) -> np.ndarray:
    held = np.ones(len(table), bool)
    for condition in rule:
        held &= condition.holds(table)
    return held


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained on the covered bad documents; 0 where nothing bad is covered."""
    share = np.divide(p, p + n, out=np.full(len(p), 1e-12), where=p > 0)
    return p * (np.log2(share) - np.log2(p0 / (p0 + n0)))


def grow(table: np.ndarray, bad: np.ndarray) -> Rule:
    """Conditions by greatest gain until only bad documents are covered."""
    rule: list[Condition] = []
    held = np.ones(len(table), bool)
    while len(rule) < MAX_CONDITIONS and (held & ~bad).any() and (held & bad).any():
        x, y = table[held], bad[held]
        best: tuple[float, Condition] | None = None
        for i, name in enumerate(FEATURES):
            cuts = np.unique(np.quantile(x[y, i], np.linspace(0, 1, CUTS)).round(9))
            order = np.argsort(x[:, i], kind="stable")
            values, hits = x[order, i], np.concatenate([[0], np.cumsum(y[order])])
            for above in (True, False):
                # A bad document at the cut itself has to be covered: cut just below it.
                at = cuts - 1e-9 if above else cuts
                below = np.searchsorted(values, at, "right")
                p = hits[-1] - hits[below] if above else hits[below]
                n = (len(values) - below if above else below) - p
                gains = _gain(p.astype(float), n.astype(float), int(y.sum()), int((~y).sum()))
                j = int(np.argmax(gains))
                if gains[j] > 1e-9 and (best is None or gains[j] > best[0]):
                    best = float(gains[j]), Condition(name, above, float(at[j]))
        if best is None:
            break
        rule.append(best[1])
        held &= best[1].holds(table)
    return tuple(rule)


def worth(rule: Rule, table: np.ndarray, bad: np.ndarray) -> float:
    held = covers(rule, table)
    p, n = int((held & bad).sum()), int((held & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, table: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most."""
    parts = [rule[:i] for i in range(1, len(rule) + 1)]
    return max(parts, key=lambda part: (worth(part, table, bad), -len(part)))


def learn(table: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules that reject; empty without bad or without good documents."""
    rules: list[Rule] = []
    held_out = np.arange(len(table)) % 3 == 2
    left = np.ones(len(table), bool)
    while len(rules) < MAX_RULES and (left & bad).any() and (~bad).any():
        rule = grow(table[left & ~held_out], bad[left & ~held_out])
        check = left & held_out
        if not rule or not (check & bad).any():
            break
        rule = prune(rule, table[check], bad[check])
        if worth(rule, table[check], bad[check]) < 2 * MIN_PRECISION - 1:
            break
        rules.append(rule)
        left &= ~covers(rule, table)
    return rules


def decision_list(rules: list[Rule], stats: str = "stats") -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    by_name = features(stats)
    chain = None
    for number, rule in enumerate(rules, 1):
        held = F.lit(True)
        for condition in rule:
            held = held & condition.column(by_name)
        chain = F.when(held, F.lit(number)) if chain is None else chain.when(held, F.lit(number))
    return F.lit(None).cast("int") if chain is None else chain


def base_failed(stats: str = "stats") -> Column:
    """Too few words, or more than half of them in repeated windows."""
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)


def learned(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> list[Rule]:
    """Rules from a bounded sample of labelled documents that the base rules let pass."""
    sample = labelled_sample(docs, labels, sample_rows, key=key, text=text).filter(~base_failed())
    rows = sample.orderBy(F.xxhash64("key"), "key", *FEATURES).select("label", *FEATURES).toPandas()
    return learn(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(int) == 0)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: the counts, whether base rules fail, the rule that rejects, and the verdict.

    Result: ``key``, the counts, ``base_failed``, ``rule`` (null: none), ``kept``. Every row gives one row, repeated
    ones too. A null or empty text has no words and fails the base rules. Without usable labels, or on an empty
    table, no rule is learned and only the base rules reject. Other columns are not read.
    """
    rules = learned(docs, labels, sample_rows, key, text)
    rows = with_statistics(docs.select(key, text), text)
    judged = rows.select(F.col(f"row.`{key}`").alias(key), "stats", base_failed().alias("base_failed"), decision_list(rules).alias("rule"))
    return judged.select(key, *[F.col(f"stats.{c}").alias(c) for c in COUNTS], "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
