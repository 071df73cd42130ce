"""Scores of features, their weights, and the choice of the top ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Decay, Scoring
from ..sources.logs import LOG, LogSchema
from .context import case_order, numbered, sequenced
from .encoding import with_arrival_code
from .folds import fold


def resource_rarity(log: DataFrame, s: LogSchema = LOG, weight: float = 1.0) -> DataFrame:
    """log with the k-th use of a resource by an activity scored weight / k."""
    k = F.row_number().over(Window.partitionBy(s.activity, s.resource).orderBy(s.time, s.event))
    return log.withColumn("rarity", F.lit(weight) / k)


def resource_rarity_literal(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log with the scores of both passes, 1 / (2k - 1) and 1 / (2k)."""
    k = F.row_number().over(Window.partitionBy(s.activity, s.resource).orderBy(s.time, s.event))
    return log.withColumns({"rarity_1": 1 / (2 * k - 1), "rarity_2": 1 / (2 * k)})


def past_occurrence_score(log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """log with 1 / (past + 1) times the sum of the calendar features' values, past counting the activity's earlier events of the same hour bin, day and month."""
    of_slot = Window.partitionBy(s.activity, "hour_bin", "day_of_week", "month").orderBy(s.time, s.event)
    value = F.col("day_of_week") + F.col("month") + F.col("is_weekend").cast("int")
    return log.withColumn("past", F.row_number().over(of_slot) - 1).withColumn("time_score", value / (F.col("past") + 1))


def ewma_weights(log: DataFrame, scores: dict[str, str], decay: Decay = Decay(), s: LogSchema = LOG) -> DataFrame:
    """log with a weight for each score (name to column): w = w * d + score * (1 - d), d = exp(-1 / tau) from an activity's second event on, first weight 1.

    The recurrence is linear, so it is a running sum: with D(c) = exp(-c / tau), w = D(c) / D(1) + sum of score * (1 - d) * D(c) / D(k) over k = 2..c.
    The sums are taken in blocks of the counter, each relative to its own start, so that nothing overflows and no task sees an activity; blocks are then
    chained by a fold over one row each.  before_<name> is the weight that the event found.
    """
    d = math.exp(-1 / decay.tau)
    span = int(100 * decay.tau)
    rows = numbered(log, [s.activity], "__c", s).withColumn("__block", F.floor((F.col("__c") - 1) / span))
    rows = rows.withColumn("__age", F.col("__c") - F.col("__block") * span)  # from 1
    in_block = Window.partitionBy(s.activity, "__block").orderBy("__c")
    own = lambda c: F.when(F.col("__c") == 1, F.lit(0.0)).otherwise(F.col(c) * (1 - d)) * F.exp(F.col("__age") / decay.tau)
    rows = rows.withColumns({f"__own_{k}": F.exp(-F.col("__age") / decay.tau) * F.sum(own(c)).over(in_block) for k, c in scores.items()})
    ends = rows.groupBy(s.activity, "__block").agg(F.max("__age").alias("age"), *[F.max_by(f"__own_{k}", "__age").alias(k) for k in scores])
    chain = Window.partitionBy(s.activity).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    ends = ends.withColumn("past", F.collect_list(F.struct("age", *scores)).over(chain))
    # the first event only sets the weight, which is as if it were 1 / d before it

    def start(name: str) -> Column:
        return F.aggregate(F.col("past"), F.lit(1 / d), lambda w, x: w * F.exp(-x["age"] / decay.tau) + x[name])

    starts = {k: start(k) for k in scores}
    ends = ends.select(F.col(s.activity).alias("__a"), F.col("__block").alias("__b"), *[x.alias(f"__start_{k}") for k, x in starts.items()])
    out = rows.join(ends, (F.col(s.activity) == F.col("__a")) & (F.col("__block") == F.col("__b")))
    out = out.withColumns({k: F.col(f"__start_{k}") * F.exp(-F.col("__age") / decay.tau) + F.col(f"__own_{k}") for k in scores})
    out = out.withColumns({f"before_{k}": F.when(F.col("__c") == 1, F.lit(1.0)).otherwise((F.col(k) - F.col(c) * (1 - d)) / d) for k, c in scores.items()})
    return out.drop("__c", "__block", "__age", "__a", "__b", *[f"__own_{k}" for k in scores], *[f"__start_{k}" for k in scores])


def ewma_weight(log: DataFrame, score: str, decay: Decay = Decay(), s: LogSchema = LOG) -> DataFrame:
    """log with weight, of one score."""
    return ewma_weights(log, {"weight": score}, decay, s).drop("before_weight")


def ewma_weight_literal(log: DataFrame, score: str, decay: Decay = Decay(), s: LogSchema = LOG) -> DataFrame:
    """The same when one counter of last use serves all activities, so that gaps may be negative and d over 1.

    Gaps telescope over the whole log, so that the weight is a running sum in its order: with E(c) = exp((c - top) / tau), w = (w0 * E(c0) + sum of
    score * (1 - d) * E(c)) / E(c), where w0 and c0 are those of the row before the block.  The sums are taken in blocks of the order, each relative to the
    highest counter that it meets, so that nothing overflows however long the log is; blocks are then chained by a fold over one row each.  Weights that
    a double can't hold, where counters of two activities are over 700 * tau apart, are not reproduced.
    """
    span = max(1, int(100 * decay.tau))  # rows of a block, in which a counter grows by as much at most
    rows = sequenced(numbered(log, [s.activity], "__c", s), s).withColumns({"__c": F.col("__c").cast("double"), "__block": F.floor((F.col("seq") - 1) / span)})
    in_block = Window.partitionBy("__block").orderBy("seq")
    earlier = Window.orderBy("__b")  # a row for each block
    ends = rows.groupBy(F.col("__block").alias("__b")).agg(F.max_by("__c", "seq").alias("__last"), F.max("__c").alias("__top"))
    # the first event, whose counter is 1, only sets the weight: its gap is 0
    ends = ends.withColumn("__from", F.coalesce(F.lag("__last").over(earlier), F.lit(1.0))).withColumn("__top", F.greatest("__top", "__from"))
    rows = rows.withColumn("__lag", F.lag("__c").over(in_block)).join(ends, F.col("__block") == F.col("__b")).drop("__b")
    d = F.exp(-(F.col("__c") - F.coalesce("__lag", "__from")) / decay.tau)
    rows = rows.withColumn("__part", F.col(score) * (1 - d) * F.exp((F.col("__c") - F.col("__top")) / decay.tau))
    sums = rows.groupBy("__block").agg(F.sum("__part").alias("__sum"), *[F.first(c).alias(c) for c in ("__from", "__last", "__top")]).withColumn("__log", F.lit(0))

    def chain(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for total, c0, c, top in zip(pdf["__sum"], pdf["__from"], pdf["__last"], pdf["__top"]):
            out.append(state["w"] * np.exp((c0 - top) / decay.tau))
            state["w"] = (out[-1] + total) * np.exp((top - c) / decay.tau)
        return pd.DataFrame({"__b": pdf["__block"], "__start": out})

    starts = fold(sums, "__log", "__block", lambda _: {"w": 1.0}, chain, "__b long, __start double")
    rows = rows.withColumn("__sum", F.sum("__part").over(in_block)).join(starts, F.col("__block") == F.col("__b"))
    weight = F.exp((F.col("__top") - F.col("__c")) / decay.tau) * (F.col("__start") + F.col("__sum"))
    return rows.withColumn("weight", weight).select(*[c for c in log.columns if c != "weight"], "weight")


def time_score(codes: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Sum of weight times code over the calendar features."""
    out = F.lit(0.0)
    for name, code in codes.items():
        out = out + weights[name] * code
    return out


def data_change(log: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], scoring: Scoring = Scoring(), s: LogSchema = LOG) -> DataFrame:
    """log with score_<column>: raised where the value differs from the case's last event, shrunk by the seconds since then."""
    of_case = case_order(s)
    seconds = (F.unix_micros(s.time) - F.unix_micros(F.lag(s.time).over(of_case))) / 1e6
    fade = F.exp(-scoring.seconds_decay * F.coalesce(seconds, F.lit(0.0)))
    out = {}
    for c in numeric:
        before = F.lag(c).over(of_case)
        moved = F.pow(F.col(c) - before, 2) / 4 > scoring.variance_threshold
        out[f"score_{c}"] = scoring.data_weight * F.when(moved, scoring.numeric_boost).otherwise(1.0) * fade
    for c in categorical:
        other = F.lag(c).over(of_case) != F.col(c)
        out[f"score_{c}"] = scoring.data_weight * F.when(other, scoring.category_boost).otherwise(1.0) * fade
    return log.withColumns(out)


def adaptive_threshold(scores: Column, scoring: Scoring = Scoring()) -> Column:
    """The scores' population deviation over ten, within bounds; 1 for none."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x * x) / n
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    low, high = scoring.threshold_bounds
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.greatest(sd / scoring.threshold_divisor, F.lit(low)), F.lit(high)))


def top_features(scores: dict[str, Column], scoring: Scoring = Scoring()) -> Column:
    """Names of the features with the highest scores, as many as the threshold's whole part; earlier ones first among equals."""
    values = F.array(*[x.cast("double") for x in scores.values()])
    ranked = F.array_sort(F.array(*[F.struct((-x.cast("double")).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, x) in enumerate(scores.items())]))
    n = F.floor(F.least(adaptive_threshold(values, scoring), F.lit(float(scoring.max_top)))).cast("int")
    return F.transform(F.slice(ranked, F.lit(1), n), lambda x: x["name"])


#: Calendar features that are scored by their codes, and the one that is 0 or 1.
CODED, FLAG = ("hour_bin", "day_of_week", "month"), "is_weekend"


def feature_scores(log: DataFrame, s: LogSchema = LOG, decay: Decay = Decay(), scoring: Scoring = Scoring()) -> DataFrame:
    """log with scores, a map of feature to score in the order of the step, and threshold, top, mean_score; log has seq and the calendar columns.

    The context scores 0; the resource the weight it has by then over the number of its uses; the time the weighted sum of the calendar features'
    codes.  Weights are those that the events before left, from 1.  A score that is no number counts 0.
    """
    rows = resource_rarity(log, s)
    for c in CODED:
        rows = with_arrival_code(rows, c, f"__code_{c}")
    rows = rows.withColumns({f"__code_{c}": F.col(f"__code_{c}").cast("double") for c in CODED} | {f"__code_{FLAG}": F.coalesce(F.col(FLAG), F.lit(False)).cast("double")})
    features = {"__w_resource": "rarity"} | {f"__w_{c}": f"__code_{c}" for c in (*CODED, FLAG)}
    rows = ewma_weights(rows, features, decay, s)
    time = time_score({c: F.col(f"__code_{c}") for c in (*CODED, FLAG)}, {c: F.col(f"before___w_{c}") for c in (*CODED, FLAG)})
    zero = F.lit(0.0)
    scores = {f"prev_activity_{i + 1}": zero for i in range(scoring.context)} | {s.resource: F.col("before___w_resource") * F.col("rarity"), "time_score": time}
    number = lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
    scores = {k: number(x) for k, x in scores.items()}
    values = F.array(*scores.values())
    made = {"scores": F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), v)]), "threshold": adaptive_threshold(values, scoring), "top": top_features(scores, scoring), "mean_score": F.aggregate(values, zero, lambda a, x: a + x) / F.size(values)}
    rows = rows.withColumns(made)
    return rows.select(*log.columns, *made)


def deviations(log: DataFrame, column: str, s: LogSchema = LOG) -> DataFrame:
    """log with z: how far an event's value lies from its activity's events before, in their deviations; a deviation of 0 counts 1.

    Running sums in two levels, totals of the hours before and rows within an hour, so that no task sees an activity's whole history.
    """
    x = F.col(column).cast("double")
    center = log.agg(F.avg(x).alias("__center"))  # sums about the mean lose no digits
    rows = log.join(F.broadcast(center)).withColumns({"__hour": F.date_trunc("hour", s.time), "__x": x - F.col("__center")})  # one row
    parts = {"n": F.count("__x"), "s": F.sum("__x"), "q": F.sum(F.col("__x") * F.col("__x"))}
    hours = rows.groupBy(s.activity, "__hour").agg(*[v.alias(k) for k, v in parts.items()])
    earlier = Window.partitionBy(s.activity).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)  # a row for each hour
    hours = hours.select(F.col(s.activity).alias("__a"), F.col("__hour").alias("__h"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__{k}") for k in parts])
    within = Window.partitionBy(s.activity, "__hour").orderBy(s.time, s.event).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__own_{k}": F.coalesce(v.over(within), F.lit(0)) for k, v in parts.items()})
    rows = rows.join(hours, (F.col(s.activity) == F.col("__a")) & (F.col("__hour") == F.col("__h")))
    n, total, square = (F.col(f"__{k}") + F.col(f"__own_{k}") for k in parts)
    mean = total / n
    sd = F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0)))
    z = F.when(n > 0, F.abs(F.col("__x") - mean) / F.when(sd > 1e-9, sd).otherwise(1.0))
    return rows.withColumn("z", z).select(*log.columns, "z")


def sliding_statistics(log: DataFrame, column: str, size: int = 1000, s: LogSchema = LOG) -> DataFrame:
    """log with n, total and sd over the last size events of the activity, the event included.

    An activity's events are cut into blocks of size; a block takes the one before along, which holds all that its windows reach.
    """
    rows = numbered(log, [s.activity], "__c", s).withColumn("__block", F.floor((F.col("__c") - 1) / size))
    near = rows.withColumn("__for", F.explode(F.array(F.col("__block"), F.col("__block") + 1)))
    w = Window.partitionBy(s.activity, "__for").orderBy("__c").rowsBetween(1 - size, 0)
    out = near.withColumns({"n": F.count("*").over(w), "total": F.sum(column).over(w), "sd": F.stddev_pop(column).over(w)})
    return out.where("__for = __block").select(*log.columns, "n", "total", "sd")
