"""Change detection by adaptive windowing, after Bifet and Gavalda, "Learning from time-changing data with adaptive windowing" (2007)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

from .folds import fold


class Adwin:
    """Keeps a window of values in buckets of doubling size, and drops the older part when its mean differs from the newer part's."""

    def __init__(self, delta: float = 0.02, per_row: int = 5, check_every: int = 32, least: int = 5):
        self.delta, self.per_row, self.check_every, self.least = delta, per_row, check_every, least
        self.rows: list[list[tuple[float, float]]] = [[]]  # rows[k]: (sum, squares about the mean) of 2 ** k values, newest first
        self.n, self.sum, self.seen = 0, 0.0, 0

    def update(self, value: float) -> bool:
        """Whether the value made a change evident."""
        self.seen += 1
        self.rows[0].insert(0, (value, 0.0))
        self.n, self.sum = self.n + 1, self.sum + value
        for k, row in enumerate(self.rows):
            if len(row) <= self.per_row:
                break
            (s2, q2), (s1, q1) = row.pop(), row.pop()
            size = 2**k
            joined = (s1 + s2, q1 + q2 + (s1 - s2) ** 2 / (2 * size))
            if k + 1 == len(self.rows):
                self.rows.append([])
            self.rows[k + 1].insert(0, joined)
        if self.seen % self.check_every:
            return False
        changed = False
        while self._cut():
            changed = True
        return changed

    def _variance(self) -> float:
        mean = self.sum / self.n
        return sum(q + 2**k * (s / 2**k - mean) ** 2 for k, row in enumerate(self.rows) for s, q in row) / self.n

    def _cut(self) -> bool:
        """Drops the oldest bucket if some split of the window shows a change."""
        if self.n < 2 * self.least:
            return False
        variance, old_n, old_sum = self._variance(), 0, 0.0
        strict = math.log(2 * math.log(self.n) / self.delta)
        for k in range(len(self.rows) - 1, -1, -1):
            for s, _ in reversed(self.rows[k]):
                old_n, old_sum = old_n + 2**k, old_sum + s
                new_n = self.n - old_n
                if new_n < self.least:
                    return False
                if old_n < self.least:
                    continue
                m = 1 / (1 / old_n + 1 / new_n)
                bound = math.sqrt(2 / m * variance * strict) + 2 / (3 * m) * strict
                if abs(old_sum / old_n - (self.sum - old_sum) / new_n) > bound:
                    top = max(i for i, row in enumerate(self.rows) if row)
                    gone, _ = self.rows[top].pop()
                    self.n, self.sum = self.n - 2**top, self.sum - gone
                    return True
        return False


def drifts(values: DataFrame, delta: float = 0.02) -> DataFrame:
    """feature and seq of each change; values: feature, seq, value.  The fold runs feature by feature."""

    def step(detector: Adwin, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[[detector.update(v) for v in pdf["value"].tolist()], ["feature", "seq"]]

    return fold(values.where("value is not null").select("feature", "seq", "value"), "feature", "seq", lambda _: Adwin(delta), step, "feature string, seq long")


#: What a change does to a feature's weight, what none does, and the bounds of either.
RAISED, LOWERED, MOST, LEAST = 1.1, 0.9, 2.0, 0.5


class _Weighted:
    def __init__(self, delta: float):
        self.detector, self.weight = Adwin(delta), 1.0

    def add(self, value: float) -> tuple[bool, float]:
        changed = self.detector.update(value)
        self.weight = min(self.weight * RAISED, MOST) if changed else max(self.weight * LOWERED, LEAST)
        return changed, self.weight


def drift_weights(values: DataFrame, delta: float = 0.02) -> DataFrame:
    """feature, seq, changed and weight after each look at a feature's mean score; values: feature, seq, value."""

    def step(state: _Weighted, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [state.add(v) for v in pdf["value"].tolist()]
        return pdf[["feature", "seq"]].assign(changed=[c for c, _ in got], weight=[w for _, w in got])

    return fold(values.where("value is not null").select("feature", "seq", "value"), "feature", "seq", lambda _: _Weighted(delta), step, "feature string, seq long, changed boolean, weight double")
