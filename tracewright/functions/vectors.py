"""Expressions over array<double> columns, and the similarity of two vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def minmax(v: str) -> Column:
    """A vector scaled to its own range; zeros if it has none, empty if empty."""
    low, high = F.array_min(v), F.array_max(v)
    return F.when(high > low, F.expr(f"transform({v}, __x -> (__x - array_min({v})) / (array_max({v}) - array_min({v})))")).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def zscore(v: str) -> Column:
    """A vector less its mean, by its population deviation; zeros if that is 0."""
    mean = f"aggregate({v}, 0D, (__s, __x) -> __s + __x) / size({v})"
    sd = f"sqrt(aggregate({v}, 0D, (__s, __x) -> __s + (__x - __m) * (__x - __m)) / size({v}))"
    scaled = f"if(__d > 0, transform({v}, __x -> (__x - __m) / __d), transform({v}, __x -> 0D))"
    # arrays of one element bind the mean and the deviation, which are else computed again for every slot
    return F.expr(f"transform(array({mean}), __m -> transform(array({sd}), __d -> {scaled})[0])[0]")


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def moved_mean(centroid: Column | str, v: Column | str, weight: Column | str) -> Column:
    """The mean of weight vectors, from the mean of the others and the last."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.zip_with(centroid, v, lambda c, x: (c * (w - 1) + x) / w)


def linspace(low: float, high: float, n: int) -> Column:
    """n + 1 edges."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(low) + i * (high - low) / n)


def kernel_sum(a: str, b: str, alpha: float) -> Column:
    """Sum over all pairs of slots of max(1 - (a_i - b_j)^2, 0), pairs off the diagonal weighted by alpha; null for unequal lengths."""
    inner = f"aggregate({b}, named_struct('j', 0, 's', 0D), (__t, __y) -> named_struct('j', __t.j + 1, 's', __t.s + greatest(1 - (__r.x - __y) * (__r.x - __y), 0D) * if(__r.i = __t.j, 1D, {alpha}D)), __t -> __t.s)"
    return F.expr(f"if(size({a}) = size({b}), aggregate(transform({a}, (__x, __i) -> named_struct('x', __x, 'i', __i)), 0D, (__s, __r) -> __s + {inner}), null)")


def similarity(a: str, b: str, alpha: float, normaliser: str = "reference") -> Column:
    """Similarity under unit weights, from 0 to 1; 0 for unequal lengths.

    reference divides by the length, so that it nearly always reads 1; pairs divides by the sum of the weights; diagonal is pairs at alpha 0.
    """
    if normaliser == "diagonal":
        alpha = 0.0
    n = F.size(a)
    by = n + alpha * n * (n - 1) if normaliser == "pairs" else n
    return F.coalesce(F.least(F.greatest(kernel_sum(a, b, alpha) / by, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def numeric_cell(text: Column) -> Column:
    """A cell as a number; null for what stands for a missing value, and for what is none."""
    t = F.lower(F.trim(text.cast("string")))
    value = F.when(t.isin("nan", "null", "", "m"), None).otherwise(t.try_cast("double"))
    return F.when(F.isnan(value), None).otherwise(value)
