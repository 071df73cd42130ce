"""Incremental clustering of an activity's vectors, verdicts and refined labels: one fold, shared by batch and stream."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Decay, Params
from .folds import fold

RESULT = "cluster_id int, best_sim double, n_active int, verdict string, refined_activity string, weight double, step long"


def similarities(centroids: np.ndarray, v: np.ndarray, alpha: float, normaliser: str) -> np.ndarray:
    """Similarity of v to each row of centroids, unit weights."""
    n = len(v)
    if normaliser == "diagonal":
        return np.clip(np.maximum(1 - (centroids - v) ** 2, 0).sum(1) / n, 0, 1)
    cell = np.maximum(1 - (centroids[:, :, None] - v[None, None, :]) ** 2, 0)
    raw = alpha * cell.sum((1, 2)) + (1 - alpha) * np.einsum("kii->k", cell)
    return np.clip(raw / (n + alpha * n * (n - 1) if normaliser == "pairs" else n), 0, 1)


def weighted_similarities(vectors: np.ndarray, alpha: float) -> np.ndarray:
    """The matrix of similarities under the vectors' variance weights."""
    var = vectors.var(0)
    w = np.maximum(var / var.sum() if var.sum() > 0 else np.ones_like(var), 0.1)
    w = w / w.sum()
    pen = np.full((len(w), len(w)), alpha)
    np.fill_diagonal(pen, 1)
    pen = pen * (w[:, None] + w[None, :]) / 2
    cell = np.maximum(1 - (vectors[:, None, :, None] - vectors[None, :, None, :]) ** 2, 0)
    return np.clip((cell * pen).sum((2, 3)) / w.sum(), 0, 1)


def verdict_of(sim: np.ndarray, split: float, merge: float) -> str:
    off = ~np.eye(len(sim), dtype=bool)
    if len(sim) < 2:
        return "no_change"
    if (sim[off] < split).any():
        return "split"
    near = (sim > merge) & off
    single = np.flatnonzero(near.sum(1) == 1)
    return "merge" if len(single) == 2 and near[single[0], single[1]] else "no_change"


class Clusters:
    """State of one activity."""

    def __init__(self, params: Params = Params(), state: dict | None = None):
        self.params = params
        s = state or {}
        self.count, self.next, self.ordinal = s.get("count", 0), s.get("next", 0), dict(s.get("ordinal", {}))
        self.clusters: dict[int, dict] = s.get("clusters", {})

    def state(self) -> dict:
        return {"count": self.count, "next": self.next, "ordinal": self.ordinal, "clusters": self.clusters}

    def _forget(self) -> None:
        decay = self.params.decay
        if self.params.mode == "literal":
            self.clusters = {}
            self.next = 0
            return
        fade = math.exp(-1 / decay.tau)  # the counter moves by one between two steps
        for k, c in list(self.clusters.items()):
            c["weight"] *= fade
            if c["weight"] < decay.floor and self.count - c["last"] > decay.removal_gap:
                del self.clusters[k]
        while len(self.clusters) > decay.budget:
            del self.clusters[min(self.clusters, key=lambda k: (self.clusters[k]["weight"], k))]

    def add(self, vector: Iterable[float], label: str) -> tuple[int, float | None, int, str, str, float, int]:
        """(cluster, best similarity, active clusters, verdict, refined label, the cluster's weight, the activity's counter)."""
        p = self.params.clustering
        v = np.asarray(vector, float)
        self.count += 1
        self._forget()
        best = None
        if self.clusters:
            ids = list(self.clusters)
            same = [k for k in ids if len(self.clusters[k]["centroid"]) == len(v)]
            sims = dict.fromkeys(ids, 0.0)
            if same:
                got = similarities(np.array([self.clusters[k]["centroid"] for k in same]), v, p.alpha, p.normaliser)
                sims.update(zip(same, got.tolist()))
            chosen = max(ids, key=lambda k: (sims[k], -k))
            best = sims[chosen]
        if best is None or best < p.split:
            chosen, self.next = self.next, self.next + 1
            self.clusters[chosen] = {"centroid": v.tolist(), "weight": 1.0, "last": self.count}
        else:
            c = self.clusters[chosen]
            c["last"] = self.count
            if best > p.merge:
                c["weight"] += 1
                c["centroid"] = (np.asarray(c["centroid"]) + (v - c["centroid"]) / c["weight"]).tolist()
        active = [k for k, c in self.clusters.items() if c["weight"] > p.active_weight]
        self.ordinal.setdefault(chosen, len(self.ordinal) + 1)
        refined = label if self.params.mode == "literal" or len(active) <= 1 else f"{label}_{self.ordinal[chosen]}"
        return chosen, best, len(active), self._verdict(active, v), refined, self.clusters[chosen]["weight"], self.count

    def _verdict(self, active: list[int], v: np.ndarray) -> str:
        p = self.params.clustering
        if self.params.mode == "literal":
            return verdict_of(np.ones((2, 2)), p.analysis_split, p.analysis_merge)  # a vector against itself
        others = [self.clusters[k]["centroid"] for k in active if len(self.clusters[k]["centroid"]) == len(v) and not np.array_equal(self.clusters[k]["centroid"], v)]
        if not others:
            return "no_change"
        return verdict_of(weighted_similarities(np.array([*others, v]), p.analysis_alpha), p.analysis_split, p.analysis_merge)


def refine(vectors: DataFrame, params: Params = Params(), activity: str = "Activity") -> DataFrame:
    """seq, the activity and RESULT for every event; vectors: seq, the activity, vector.

    The order within an activity matters, so an activity is one group; only seq, label and vector are sent to it.  The literal mode depends on no order, and needs none of this.
    """
    if params.mode == "literal":
        return vectors.select("seq", activity, F.lit(0).alias("cluster_id"), F.lit(None).cast("double").alias("best_sim"), F.lit(1).alias("n_active"), F.lit("merge").alias("verdict"), F.col(activity).alias("refined_activity"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("step"))

    names = [c.split()[0] for c in RESULT.split(", ")]

    def step(clusters: Clusters, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [clusters.add(v, a) for v, a in zip(pdf["vector"], pdf[activity])]
        return pd.concat([pdf[["seq", activity]], pd.DataFrame(rows, columns=names, index=pdf.index).astype({"best_sim": "float64"})], axis=1)

    kind = vectors.schema[activity].dataType.simpleString()
    return fold(vectors.select("seq", activity, "vector"), activity, "seq", lambda _: Clusters(params), step, f"seq long, {activity} {kind}, {RESULT}")


def audit(refined: DataFrame, activity: str = "Activity", key: str = "seq") -> DataFrame:
    """One record for each event that made a cluster or whose verdict asks for a change; key names the event."""
    made = F.col("best_sim").isNull() | (F.col("best_sim") < Params().clustering.split)
    action = F.when(made, "cluster_create").when(F.col("verdict") != "no_change", F.concat(F.col("verdict"), F.lit("_decision")))
    details = F.to_json(F.struct("cluster_id", "best_sim", "n_active"))
    return refined.select(key, F.lit("INFO").alias("level"), action.alias("action"), F.col(activity).alias("label"), details.alias("details")).where("action is not null")


def cluster_summary(refined: DataFrame, activity: str = "Activity", decay: Decay = Decay()) -> DataFrame:
    """Clusters of each activity, how many events they took, and their weights at the end: faded by one step for each of the activity's events since their last one."""
    total = refined.groupBy(activity).agg(F.count("*").alias("n_events"), F.max("step").alias("end"))
    sizes = refined.groupBy(activity, "cluster_id").agg(F.count("*").alias("n"), F.max_by("weight", "seq").alias("weight"), F.max("step").alias("last"))
    sizes = sizes.join(F.broadcast(total), activity).withColumn("weight", F.col("weight") * F.exp(-(F.col("end") - F.col("last")) / decay.tau))  # a row for each label
    return sizes.groupBy(activity).agg(F.count("*").alias("n_clusters"), F.avg("n").alias("mean_size"), F.avg("weight").alias("mean_weight"), F.sum("weight").alias("total_weight"), F.max("n_events").alias("n_events"))


def vector_metadata(refined: DataFrame, activity: str = "Activity") -> DataFrame:
    """Each activity's vectors with how often and when last they were seen, the label that the last event gave, and their place in the order of (frequency, last_seen)."""
    rows = refined.groupBy(activity, "vector").agg(F.count("*").alias("frequency"), F.max("seq").alias("last_seen"), F.max_by("refined_activity", "seq").alias("refined_label"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(activity).orderBy("frequency", "last_seen")))


def most_frequent_vectors(vectors: DataFrame, activity: str = "Activity") -> DataFrame:
    """Each activity's most frequent vector, the first seen among equals, and how often it occurs; vectors: seq, the activity, vector."""
    rows = vectors.groupBy(activity, "vector").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return rows.groupBy(activity).agg(F.max_by("vector", F.struct("n", -F.col("first"))).alias("vector"), F.max("n").alias("n"))


def decayed_frequencies(vectors: DataFrame, decay: Decay = Decay(), activity: str = "Activity") -> DataFrame:
    """Each activity's vectors with their decayed frequency at the end of the log; vectors: the activity, k (the activity's counter), vector.

    An occurrence counts exp(-(last k - its k) / tau): shrinking every frequency at each event, in closed form.  A vector below the floor that
    was not seen for the removal gap goes, and the budget keeps an activity's largest.
    """
    end = vectors.groupBy(activity).agg(F.max("k").alias("end"))
    rows = vectors.join(F.broadcast(end), activity)  # a row for each label
    rows = rows.groupBy(activity, "vector").agg(F.sum(F.exp(-(F.col("end") - F.col("k")) / decay.tau)).alias("frequency"), F.max("k").alias("last_seen"), F.max("end").alias("end"))
    rows = rows.where(~((F.col("frequency") < decay.floor) & (F.col("end") - F.col("last_seen") > decay.removal_gap)))
    place = F.row_number().over(Window.partitionBy(activity).orderBy(F.desc("frequency"), F.desc("last_seen")))
    return rows.withColumn("place", place).where(F.col("place") <= decay.budget).drop("place", "end")
