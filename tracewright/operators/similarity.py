"""Similarity matrices of vectors, weights from variances, and the split or merge verdict."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Clustering
from ..functions.vectors import distance, kernel_sum, similarity


def variance_weights(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """group and weights: each slot's share of the population variances, at least 0.1, then summing to 1."""
    slots = vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.var_pop("x").alias("v"))
    of_group = Window.partitionBy(group)
    every = F.sum("v").over(of_group)
    share = F.greatest(F.when(every > 0, F.col("v") / every).otherwise(F.lit(1.0)), F.lit(0.1))
    slots = slots.select(group, "pos", share.alias("w"))
    slots = slots.withColumn("w", F.col("w") / F.sum("w").over(of_group))
    return slots.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("weights"))


def centroids(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """group and the mean of its vectors."""
    slots = vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("m"))
    return slots.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


#: Vectors of a group that meet in one task.
BLOCK = 256


def pairs(vectors: DataFrame, group: str, key: str, vector: str = "vector", with_self: bool = True) -> DataFrame:
    """Pairs of a group's vectors, i before j.  Groups hold micro-clusters, of which a budget keeps few; a larger group meets block by block, so that
    no task holds all of its pairs."""
    blocks = vectors.groupBy(F.col(group).alias("__g")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    a = vectors.select(group, F.col(key).alias("i"), F.col(vector).alias("a")).join(blocks, F.col(group) == F.col("__g")).drop("__g")
    b = a.select(F.col(group).alias("__g"), F.col("i").alias("j"), F.col("a").alias("b"), F.pmod(F.xxhash64("i"), F.col("__blocks")).cast("int").alias("__in"))
    a = a.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    order = F.col("i") <= F.col("j") if with_self else F.col("i") < F.col("j")
    return a.join(b, (F.col(group) == F.col("__g")) & (F.col("__with") == F.col("__in")) & order).drop("__g", "__with", "__in")


def weighted_matrix(vectors: DataFrame, group: str, key: str, alpha: float = Clustering.analysis_alpha, vector: str = "vector") -> DataFrame:
    """group, i, j and sim under the group's variance weights: the upper half of the symmetric matrix."""
    rows = pairs(vectors, group, key, vector).join(variance_weights(vectors, group, vector), group)
    cell = f"greatest(1 - (r.x - y) * (r.x - y), 0D) * if(r.i = t.j, 1D, {alpha}D) * (r.w + weights[t.j]) / 2"
    inner = f"aggregate(b, named_struct('j', 0, 's', 0D), (t, y) -> named_struct('j', t.j + 1, 's', t.s + {cell}), t -> t.s)"
    raw = F.expr(f"aggregate(transform(a, (x, i) -> named_struct('x', x, 'i', i, 'w', weights[i])), 0D, (s, r) -> s + {inner})")
    whole = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x)
    return rows.select(group, "i", "j", F.least(F.greatest(raw / whole, F.lit(0.0)), F.lit(1.0)).alias("sim"))


def pair_similarity(vectors: DataFrame, group: str, key: str, alpha: float = Clustering.alpha, vector: str = "vector") -> DataFrame:
    """Each pair's raw sum and its similarity under every normaliser."""
    rows = pairs(vectors, group, key, vector, with_self=False)
    return rows.select(group, "i", "j", kernel_sum("a", "b", alpha).alias("raw"), similarity("a", "b", alpha).alias("reference"), similarity("a", "b", alpha, "pairs").alias("pairs"), similarity("a", "b", alpha, "diagonal").alias("diagonal"))


def distance_statistics(vectors: DataFrame, group: str, key: str, vector: str = "vector") -> DataFrame:
    """group, pairs, mean and population deviation of the distances between its vectors, and the variability within its bounds."""
    out = pairs(vectors, group, key, vector, with_self=False).select(group, distance("a", "b").alias("d")).groupBy(group)
    out = out.agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean_distance"), F.stddev_pop("d").alias("sd_distance"))
    return out.withColumn("variability", F.least(F.greatest((F.col("mean_distance") + F.col("sd_distance")) / 10, F.lit(0.2)), F.lit(1.5)))


def verdicts(matrix: DataFrame, group: str, params: Clustering = Clustering()) -> DataFrame:
    """group and verdict: split if some pair is less alike than the split threshold; merge if exactly two vectors have exactly one
    neighbour above the merge threshold, and those two are each other's; else no_change."""
    off = matrix.where("i != j")
    least = off.groupBy(group).agg(F.min("sim").alias("least"))
    near = off.where(F.col("sim") > params.analysis_merge)
    both = near.select(group, "i", "j").unionByName(near.select(group, F.col("j").alias("i"), F.col("i").alias("j")))
    one = both.groupBy(group, "i").agg(F.count("*").alias("n"), F.min("j").alias("j")).where("n = 1")
    two = one.groupBy(group).agg(F.count("*").alias("singles"), F.array_sort(F.collect_list(F.struct("i", "j"))).alias("x"))
    mutual = (F.col("singles") == 2) & (F.col("x")[0]["j"] == F.col("x")[1]["i"])
    out = matrix.select(group).distinct().join(least, group, "left").join(two.select(group, mutual.alias("mutual")), group, "left")
    return out.select(group, F.when(F.col("least") < params.analysis_split, "split").when(F.col("mutual"), "merge").otherwise("no_change").alias("verdict"))


def dissimilar(matrix: DataFrame, group: str, split: float = Clustering.analysis_split) -> DataFrame:
    """group and members: the vectors that some other of the group is less like than the split threshold."""
    far = matrix.where((F.col("i") != F.col("j")) & (F.col("sim") < split)).select(group, F.explode(F.array("i", "j")).alias("member"))
    return far.groupBy(group).agg(F.array_sort(F.collect_set("member")).alias("members"))


def similar_groups(matrix: DataFrame, group: str, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """group, number and member: greedy groups of two or more, as the rows come: a row takes all later free ones that are more like it than high, and
    more like every one taken than low.  A group's matrix is one task's, of a budget's size."""
    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["i"], *pdf["j"]})
        place = {x: k for k, x in enumerate(names)}
        sim = np.zeros((len(names), len(names)))
        a, b = pdf["i"].map(place).to_numpy(), pdf["j"].map(place).to_numpy()
        sim[a, b] = sim[b, a] = pdf["sim"]
        free, out, number = np.ones(len(names), bool), [], 0
        for i in range(len(names)):
            if not free[i]:
                continue
            taken = [i]
            for j in (np.flatnonzero((sim[i, i + 1 :] > high) & free[i + 1 :]) + i + 1).tolist():
                if (sim[taken, j] > low).all():
                    taken.append(j)
            if len(taken) > 1:
                free[taken] = False
                out += [(pdf[group].iloc[0], number, names[k]) for k in taken]
                number += 1
        return pd.DataFrame(out, columns=[group, "number", "member"])

    return matrix.groupBy(group).applyInPandas(greedy, f"{group} {kinds[group]}, number int, member {kinds['i']}")


def adjusted_thresholds(variability: Column, split: Column | float, merge: Column | float) -> tuple[Column, Column]:
    """Split and merge thresholds after a look at the variability."""
    wide = variability > 0.2
    new_split = F.when(wide, F.least(split + F.lit(0.05), F.lit(1.0))).otherwise(F.greatest(split - F.lit(0.05), F.lit(0.6)))
    return new_split, F.when(wide, F.greatest(merge - F.lit(0.05), F.lit(0.5))).otherwise(F.least(merge + F.lit(0.05), F.lit(0.9)))
