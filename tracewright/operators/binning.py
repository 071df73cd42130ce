"""Discretisation of numeric columns: fixed edges, edges from quantiles and density peaks, and adaptive bins under drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Binning
from ..functions.vectors import linspace
from .drift import Adwin
from .folds import fold


def position(value: Column, edges: Column) -> Column:
    """The bin of a value plus how far it lies in it; the last bin's number for one below or at and above the edges."""
    i = F.size(F.filter(edges, lambda e: e <= value))
    last = F.size(edges) - 2
    low, high = F.get(edges, i - 1), F.get(edges, i)
    inside = (i >= 1) & (i < F.size(edges))
    return F.when(inside, (i - 1) + (value - low) / (high - low)).otherwise(last.cast("double"))


def literal_bin(value: Column, edges: Column) -> Column:
    """The nearest edge, halves to even: it may exceed the last bin."""
    return F.when(value.isNull(), 0).otherwise(F.rint(position(value, edges))).cast("int")


def bin_of(value: Column, edges: Column) -> Column:
    """The bin that holds a value, those outside in the first or last; 0 for a null."""
    i = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.when(value.isNull(), 0).otherwise(F.least(F.greatest(i, F.lit(0)), F.size(edges) - 2)).cast("int")


def uniform_edges(low: float, high: float, n: int = Binning.initial_bins) -> Column:
    return linspace(low, high, n)


def min_width_edges(edges: str, width: float = Binning.min_width) -> Column:
    """Edges, sorted, that lie at least width from the last one kept."""
    return F.expr(f"aggregate(slice({edges}, 2, size({edges})), slice({edges}, 1, 1), (kept, e) -> if(e - element_at(kept, -1) >= {width}D, concat(kept, array(e)), kept))")


def bin_counts(log: DataFrame, bins: dict[str, Column]) -> DataFrame:
    """feature, bin and n, all features in one pass."""
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), b.alias("bin")) for name, b in bins.items()])
    return log.select(F.explode(rows).alias("x")).groupBy("x.feature", "x.bin").agg(F.count("*").alias("n"))


def sparse_bins(counts: DataFrame, threshold: int = Binning.density_threshold) -> DataFrame:
    """counts with sparse: the bin and both neighbours hold less than a third of the threshold; a missing neighbour holds plenty."""
    near = Window.partitionBy("feature").orderBy("bin")
    least = threshold / 3
    plenty = 1 << 40
    sides = (F.lag("n", 1, plenty).over(near) < least) & (F.lead("n", 1, plenty).over(near) < least)
    return counts.withColumn("sparse", (F.col("n") < least) & sides)


def quantiles(log: DataFrame, columns: tuple[str, ...], points: tuple[float, ...] = Binning.quantiles, exact: bool = False) -> DataFrame:
    """feature and its quantiles, from a sketch of bounded size; exact ones hold every distinct value in one buffer, for small logs."""
    each = F.percentile if exact else lambda c, p: F.percentile_approx(c, p, 100_000)
    row = log.agg(*[each(c, list(points)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("array<double>").alias("edges")) for c in columns])).alias("x")).select("x.*")


def bin_medians(log: DataFrame, column: str, edges: Column, exact: bool = False) -> DataFrame:
    """Where each bin would be split: the median of its values, from a sketch of bounded size unless exact."""
    b = bin_of(F.col(column), edges)
    middle = F.median(column) if exact else F.percentile_approx(column, 0.5, 100_000)
    return log.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(middle.alias("median"), F.count("*").alias("n"))


def density_peaks(log: DataFrame, column: str, grid: int = Binning.grid) -> DataFrame:
    """Local maxima, ends aside, of a Gaussian kernel density on an even grid, the bandwidth being the deviation times n ** (-1/5).

    Each value adds to every grid point: a partition makes one row of sums, however many values there are.
    """
    stats = log.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.stddev_samp(column).alias("sd")).first()
    schema = "g int, x double, density double"
    if not stats["n"] or stats["n"] < 2 or not stats["sd"]:
        return log.sparkSession.createDataFrame([], schema)
    n, low, high, width = stats["n"], float(stats["low"]), float(stats["high"]), float(stats["sd"]) * stats["n"] ** -0.2
    step = (high - low) / (grid - 1)
    v = F.col(column).cast("double")
    each = [F.sum(F.exp(-F.pow((F.lit(low + g * step) - v) / width, 2) / 2)) for g in range(grid)]
    sums = log.where(v.isNotNull()).agg(F.array(*each).alias("s")).select(F.posexplode("s").alias("g", "s"))  # one row of sums for each partition
    x = F.lit(low) + F.col("g") * step
    near = Window.orderBy("g")  # grid rows
    sums = sums.select("g", x.alias("x"), (F.col("s") / (n * width * math.sqrt(2 * math.pi))).alias("density"))
    sums = sums.withColumns({"before": F.lag("density").over(near), "after": F.lead("density").over(near)})
    return sums.where("density > before and density > after").drop("before", "after")


# Adaptive bins: a fold over a feature's values in the order of the log


def _kde_peaks(values: np.ndarray, grid: int) -> list[float]:
    if len(values) < 2 or not (sd := values.std(ddof=1)) > 0:
        return []
    x = np.linspace(values.min(), values.max(), grid)
    u = (x[:, None] - values[None, :]) / (sd * len(values) ** -0.2)
    d = np.exp(-u * u / 2).sum(1)
    inner = (d[1:-1] > d[:-2]) & (d[1:-1] > d[2:])
    return x[1:-1][inner].tolist()


class AdaptiveBins:
    """Bins of one feature, whose edges are computed anew when the feature drifts."""

    def __init__(self, params: Binning = Binning()):
        self.params = params
        self.edges = [i / params.initial_bins for i in range(params.initial_bins + 1)]
        self.window: list[float] = []
        self.values: list[float] = []
        self.weights: list[float] = []
        self.counts: dict[int, int] = {}
        self.detector = Adwin(params.drift_delta)
        self.seen = 0
        self.last_split = 0

    def update(self, value: float | None) -> tuple[int, bool]:
        """The value's bin, and whether it made the feature drift; a missing value falls in bin 0 and changes nothing."""
        if value is None or math.isnan(value):
            return 0, False
        self.seen += 1
        self.values.append(value)
        self.weights.append(1.0)
        if self.seen % self.params.digest_interval == 0:
            self._decay()
        self.window = [*self.window[-self.params.window + 1 :], value]
        drifted = self.detector.update(value)
        if drifted:
            self.recompute()
        b = min(max(int(np.searchsorted(self.edges, value, "right")) - 1, 0), len(self.edges) - 2)
        self.counts[b] = self.counts.get(b, 0) + 1
        return b, drifted

    def _decay(self) -> None:
        """Older values weigh less; near ones merge, so that the sample stays bounded."""
        order = np.argsort(self.values, kind="stable")
        v, w = np.array(self.values)[order], np.array(self.weights)[order] * self.params.digest_decay
        groups = np.floor(np.cumsum(w) / w.sum() * self.params.digest_interval).astype(int)
        new = np.flatnonzero(np.diff(groups, prepend=-1))
        mass = np.add.reduceat(w, new)
        self.values, self.weights = (np.add.reduceat(v * w, new) / mass).tolist(), mass.tolist()

    def quantile(self, p: float) -> float:
        order = np.argsort(self.values, kind="stable")
        w = np.array(self.weights)[order]
        at = np.searchsorted(np.cumsum(w), p * w.sum())
        return self.values[order[min(at, len(order) - 1)]]

    def recompute(self) -> None:
        p = self.params
        edges = sorted({*(self.quantile(q) for q in p.quantiles), *_kde_peaks(np.array(self.window), p.grid)})
        kept = edges[:1]
        for e in edges[1:]:
            if e - kept[-1] >= p.min_width:
                kept.append(e)
        if len(kept) >= 2:
            self.edges, self.counts = kept, {}

    def split(self, b: int) -> bool:
        """Puts the median of a bin's values between its edges, unless one was split lately."""
        inside = [v for v in self.window if self.edges[b] <= v < self.edges[b + 1]]
        middle = float(np.median(inside)) if inside else None
        if middle is None or self.last_split and self.seen - self.last_split < self.params.split_cooldown or not self.edges[b] < middle < self.edges[b + 1]:
            return False
        self.edges.insert(b + 1, middle)
        n = self.counts.pop(b, 0)
        self.counts = {k + (k > b): v for k, v in self.counts.items()} | {b: n - n // 2, b + 1: n // 2}
        self.last_split = self.seen
        return True

    def merge_sparse(self) -> None:
        """Joins every sparse bin with the one on its right."""
        least, b = self.params.density_threshold / 3, 0
        count = lambda k: self.counts.get(k, 0) if 0 <= k < len(self.edges) - 1 else math.inf
        while b < len(self.edges) - 2:
            if count(b) < least and count(b - 1) < least and count(b + 1) < least:
                n = self.counts.pop(b, 0) + self.counts.pop(b + 1, 0)
                del self.edges[b + 1]
                self.counts = {k - (k > b): v for k, v in self.counts.items()} | {b: n}
            else:
                b += 1


def _long(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """seq, feature and value, a row for each column."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return log.select("seq", F.explode(rows).alias("x")).select("seq", "x.*")


def adaptive_bins(log: DataFrame, columns: tuple[str, ...], params: Binning = Binning()) -> DataFrame:
    """seq, feature, bin and drifted for every event and column; log has seq.  The fold runs feature by feature on (seq, value) alone."""

    def step(bins: AdaptiveBins, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [bins.update(v) for v in pdf["value"].tolist()]
        return pd.DataFrame({"seq": pdf["seq"], "feature": pdf["feature"], "bin": [b for b, _ in got], "drifted": [d for _, d in got]})

    return fold(_long(log, columns), "feature", "seq", lambda _: AdaptiveBins(params), step, "seq long, feature string, bin int, drifted boolean")


def with_bins(log: DataFrame, columns: tuple[str, ...], params: Binning = Binning()) -> DataFrame:
    """log with <column>_bin for each column: its adaptive bin at the time of the event."""
    bins = adaptive_bins(log, columns, params).groupBy("seq").pivot("feature", list(columns)).agg(F.first("bin"))
    return log.join(bins.select("seq", *[F.col(f"`{c}`").alias(f"{c}_bin") for c in columns]), "seq").select(*log.columns, *[f"{c}_bin" for c in columns])


def maintained_edges(log: DataFrame, columns: tuple[str, ...], params: Binning = Binning()) -> DataFrame:
    """feature, pos and edge at the end of the log, each feature's fullest bin split and its sparse bins merged at every cooldown's end."""

    def step(bins: AdaptiveBins, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for seq, v in zip(pdf["seq"].tolist(), pdf["value"].tolist()):
            bins.update(v)
            if bins.seen and bins.seen % params.split_cooldown == 0 and bins.counts:
                bins.split(max(bins.counts, key=lambda b: (bins.counts[b], -b)))
                bins.merge_sparse()
                rows.append((seq, list(bins.edges)))
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]] * len(rows), "seq": [s for s, _ in rows], "edges": [e for _, e in rows]})

    rows = fold(_long(log, columns), "feature", "seq", lambda _: AdaptiveBins(params), step, "feature string, seq long, edges array<double>")
    last = rows.groupBy("feature").agg(F.max_by("edges", "seq").alias("edges"))
    return last.select("feature", F.posexplode("edges").alias("pos", "edge"))
