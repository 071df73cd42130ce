"""The whole plan: from a log to refined labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.calendar import with_calendar
from ..functions.vectors import minmax
from ..operators.clustering import refine
from ..operators.context import first_rows, sequenced
from ..sources.logs import LOG, LogSchema, feature_types, valid

CALENDAR = ("hour_bin", "day_of_week", "is_weekend", "week_of_month", "season", "month")


def vector_columns(log: DataFrame, s: LogSchema = LOG) -> list[str]:
    """What a vector is made of: everything but ids, label and time."""
    return [c for c in log.columns if c not in (s.event, s.case, s.activity, s.time, "seq", "true_label")]


def with_vector(log: DataFrame, params: Params = Params(), s: LogSchema = LOG) -> DataFrame:
    """log with vector: numbers as they are, categories by a hash in [0, 1) that never changes, scaled within the vector or by feature."""
    kinds = feature_types(log)
    columns = list(s.numeric) if params.vector_features == "numeric" else vector_columns(log, s)
    # numbers of unlike units share a vector: a category's code takes the scale of a unit interval
    slots = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if kinds[c] == "numeric" else F.pmod(F.xxhash64(c), F.lit(1000)) / 1000 for c in columns}
    if params.scaling == "per_feature":
        bounds = log.agg(*[F.min(v).alias(f"__low_{c}") for c, v in slots.items()], *[F.max(v).alias(f"__high_{c}") for c, v in slots.items()])
        rows = log.join(F.broadcast(bounds))  # one row
        scaled = [F.when(F.col(f"__high_{c}") > F.col(f"__low_{c}"), (v - F.col(f"__low_{c}")) / (F.col(f"__high_{c}") - F.col(f"__low_{c}"))).otherwise(0.0) for c, v in slots.items()]
        return rows.withColumn("vector", F.array(*scaled)).drop(*bounds.columns)
    return log.withColumn("__raw", F.array(*slots.values())).withColumn("vector", minmax("__raw")).drop("__raw")


def repaired(log: DataFrame, params: Params = Params(), s: LogSchema = LOG) -> DataFrame:
    """Every valid event, once, with calendar features, cluster, verdict and refined_activity, in its own columns."""
    ready = sequenced(with_calendar(first_rows(valid(log, s), s), s.time), s)
    vectors = with_vector(ready, params, s)
    if params.mode == "literal":
        return ready.withColumns({"cluster_id": F.lit(0), "best_sim": F.lit(None).cast("double"), "n_active": F.lit(1), "verdict": F.lit("merge"), "refined_activity": F.col(s.activity), "weight": F.lit(1.0), "step": F.lit(0).cast("long")})
    labels = refine(vectors.select("seq", s.activity, "vector"), params, s.activity).drop(s.activity)
    return ready.join(labels, "seq")


def output_columns(log: DataFrame, s: LogSchema = LOG) -> list[str]:
    """What a refined row is written with: the log's columns, the calendar's, and the refined label."""
    return [c for c in log.columns if c not in CALENDAR] + [*CALENDAR, "refined_activity"]


def output(refined: DataFrame, log: DataFrame, s: LogSchema = LOG) -> DataFrame:
    """Refined rows in the columns in which they are written."""
    return refined.select(*output_columns(log, s))
