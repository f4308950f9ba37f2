"""Histograms of positions by value, gathered from Spark."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate


class Histogram:
    """Counts by value with what lies below and above the range."""

    def __init__(self, counts: dict[int, int], below: int = 0, above: int = 0):
        self.below, self.above = below, above
        self.values = sorted(counts)
        self.counts = [counts[v] for v in self.values]
        self.cumulated = list(accumulate(self.counts))

    def total_count(self) -> int:
        return self.below + self.above + (self.cumulated[-1] if self.cumulated else 0)

    def value_count(self, value: int) -> int:
        i = bisect_right(self.values, value) - 1
        return self.counts[i] if i >= 0 and self.values[i] == value else 0

    def value_percentage(self, value: int) -> float:
        return 100.0 * self.value_count(value) / self.total_count()

    def percentile_below(self, value: int) -> float:
        """Percentage of positions of at most ``value``."""
        i = bisect_right(self.values, value)
        return 100.0 * (self.below + (self.cumulated[i - 1] if i else 0)) / self.total_count()

    def mean(self) -> float:
        return sum(v * n for v, n in zip(self.values, self.counts)) / self.total_count()

    def std(self) -> float:
        squares = sum(v * v * n for v, n in zip(self.values, self.counts)) / self.total_count()
        return math.sqrt(max(0.0, squares - self.mean() ** 2))

    def percentile(self, n: float) -> int:
        """The first value with more than ``n`` percent at or below it; 0 if there is none."""
        total = self.total_count()
        return next((v for v, c in zip(self.values, self.cumulated) if 100.0 * (self.below + c) / total > n), 0)

    def median(self) -> int:
        return self.percentile(50)
