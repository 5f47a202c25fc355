"""Weak supervision: expectation-maximisation over votes, in DataFrame operations.

Votes are -1, 0 (abstain) or 1. A voter that doesn't abstain is right with its own probability,
its accuracy; abstaining says nothing. Rows with the same votes are counted first, so the table
the iterations read has at most 3 ** voters rows, however large the corpus. An iteration is one
aggregation; only the model's numbers (their count is fixed by the voters) reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracies stay between these: a voter is never taken to be wrong more often than right.
LEAST, MOST = 0.55, 0.995


@dataclass
class VoteModel:
    """prior: share of positives; accuracy: of each voter when it votes."""

    prior: float
    accuracy: list[float]

    def score(self, votes: list[Column]) -> Column:
        """Log odds that a row with these votes is positive."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, a in zip(votes, self.accuracy, strict=True):
            total = total + v.cast("double") * F.lit(math.log(a / (1 - a)))
        return total


def probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def fit_votes(patterns: DataFrame, voters: list[str], start: VoteModel, iterations: int = 15, smooth: float = 2.0, tolerance: float = 1e-3, balance: float | None = None) -> VoteModel:
    """Fit accuracies and prior on patterns (the voters' columns and a count n).

    balance, if given, is the share of positives and isn't fitted: where hardly any row is negative
    a fitted prior outvotes the voters. smooth votes at the start model's accuracies are added to each voter's. Votes are taken to be
    independent given the class. Without rows the start model comes back."""
    cols = [F.col(v) for v in voters]
    model = VoteModel(balance or start.prior, start.accuracy)
    for _ in range(iterations):
        p = probability(model.score(cols))
        aims = [F.sum("n").alias("all"), F.sum(F.col("n") * p).alias("pos")]
        for j, v in enumerate(cols):
            right = F.when(v > 0, p).when(v < 0, 1 - p).otherwise(F.lit(0.0))
            aims += [F.sum(F.col("n") * right).alias(f"r{j}"), F.sum(F.when(v != 0, F.col("n")).otherwise(F.lit(0))).alias(f"t{j}")]
        row = patterns.agg(*aims).first()
        if not row["all"]:
            return model
        fitted = [(float(row[f"r{j}"]) + smooth * a) / (float(row[f"t{j}"]) + smooth) for j, a in enumerate(start.accuracy)]
        new = VoteModel(balance or min(0.95, max(0.05, float(row["pos"]) / float(row["all"]))), [min(MOST, max(LEAST, a)) for a in fitted])
        settled = max(abs(a - b) for a, b in zip([new.prior, *new.accuracy], [model.prior, *model.accuracy], strict=True)) < tolerance
        model = new
        if settled:
            break
    return model
