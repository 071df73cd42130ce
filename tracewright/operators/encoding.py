"""Codes of categories: in the order of arrival, sorted, and frozen at first sight."""

from __future__ import annotations

import bisect
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context import ranked
from .folds import fold

#: Distinct values up to which codes are one expression over them, and up to which they are broadcast; beyond, a fold gives them.
LOW_CARDINALITY, BROADCAST_VALUES = 1000, 1_000_000


def first_seen(log: DataFrame, column: str) -> DataFrame:
    """Each value with the first event that has it; log has seq."""
    return log.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min("seq").alias("first_seq"))


def sorted_codes(log: DataFrame, column: str) -> DataFrame:
    """Each value with its rank among all values, as text, from 0."""
    values = log.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    return ranked(values, "value", "code")


def with_sorted_code(log: DataFrame, column: str, name: str) -> DataFrame:
    """log with the rank of each event's value among all values, -1 for a null; sorted_codes() are the classes."""
    codes = sorted_codes(log, column).select(F.col("value").alias("__value"), F.col("code").alias(name))
    return log.join(codes, F.col(column).cast("string") == F.col("__value"), "left").drop("__value").na.fill({name: -1})


def frozen_codes(log: DataFrame, column: str) -> DataFrame:
    """Each value with its place in the order of first sight, from 0: codes that never change."""
    return ranked(first_seen(log, column), "first_seq", "code")


def with_arrival_code(log: DataFrame, column: str, name: str) -> DataFrame:
    """log with the rank of each event's value, as text, among those seen until then.

    The number of distinct values, which is looked at first, decides how: events are never shuffled for up to BROADCAST_VALUES of them.
    """
    seen = first_seen(log, column)
    n = seen.limit(BROADCAST_VALUES + 1).count()
    if n > BROADCAST_VALUES:
        return _folded(log, column, name)
    if n > LOW_CARDINALITY:
        return _by_dimension(log, column, name)
    rows = sorted((str(r["value"]), r["first_seq"]) for r in seen.collect())
    v = F.col(column).cast("string")
    code = F.lit(0)
    for value, first in rows:
        code = code + ((v > F.lit(value)) & (F.col("seq") >= first)).cast("int")
    return log.withColumn(name, F.when(v.isNotNull(), code).otherwise(-1))


class Seen:
    """Values with the event that each was first seen at; how many less than a value had been seen by an event, for many at once.

    The values' ranks, in the order of first sight, are kept as a wavelet matrix: a count of zeros before each place for every bit.
    """

    def __init__(self, values: list[str], firsts: list[int]):
        order = np.argsort(np.array(firsts, np.int64), kind="stable")
        self.index = pd.Index(sorted(values))
        self.firsts = np.array(firsts, np.int64)[order]
        ranks = self.index.get_indexer(values)[order]
        self.levels = []
        for bit in range(max(1, int(len(values)).bit_length()) - 1, -1, -1):
            one = (ranks >> bit) & 1 == 1
            self.levels.append((bit, np.append(0, np.cumsum(~one))))
            ranks = np.concatenate([ranks[~one], ranks[one]])

    def less(self, seq: np.ndarray, values: pd.Series) -> np.ndarray:
        rank = self.index.get_indexer(values)
        low, high = np.zeros(len(rank), np.int64), np.searchsorted(self.firsts, seq, "right")
        out = np.zeros(len(rank), np.int64)
        for bit, zeros in self.levels:
            one = (rank >> bit) & 1 == 1
            a, b = zeros[low], zeros[high]
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return np.where(rank < 0, -1, out)


_seen: dict[str, Seen] = {}


def _by_dimension(log: DataFrame, column: str, name: str) -> DataFrame:
    """The values, a checked number, are broadcast, and each worker process counts its batches against them."""
    rows = first_seen(log, column).select(F.col("value").cast("string").alias("value"), "first_seq").collect()
    shared, key = log.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])), uuid.uuid4().hex

    @F.pandas_udf("int")
    def code(seq: pd.Series, value: pd.Series) -> pd.Series:
        if key not in _seen:
            _seen.clear()
            _seen[key] = Seen(*shared.value)
        return pd.Series(_seen[key].less(seq.to_numpy(), value))

    return log.withColumn(name, code(F.col("seq"), F.col(column).cast("string")))


class _Ranks:
    """A sorted list of the values seen."""

    def __init__(self) -> None:
        self.seen: list[str] = []

    def add(self, value: str) -> int:
        at = bisect.bisect_left(self.seen, value)
        if at == len(self.seen) or self.seen[at] != value:
            self.seen.insert(at, value)
        return at


def _folded(log: DataFrame, column: str, name: str) -> DataFrame:
    """For more values than are broadcast: a sorted list grows event by event, in one task for a column, on (seq, value) alone; the task holds the values, not the events."""

    def step(state: _Ranks, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seq": pdf["seq"], "code": [state.add(v) for v in pdf["value"]]})

    pairs = log.where(F.col(column).isNotNull()).select(F.lit(column).alias("feature"), "seq", F.col(column).cast("string").alias("value"))
    codes = fold(pairs, "feature", "seq", lambda _: _Ranks(), step, "seq long, code int").withColumnRenamed("code", name)
    return log.join(codes, "seq", "left").na.fill({name: -1})
