"""Folds over events in order, of a key at a time, in constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold(rows: DataFrame, key: str, order: str, begin: Callable[[Any], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What step(state, rows of one key) returns for all rows, each key's in order; begin(key) makes a key's state.

    Rows are dealt by key and sorted by Spark, which spills; a task then holds one Arrow batch and one state, however many
    events a key has.  The time of a key is serial: that is the fold's nature.  A null is a key like others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, started = None, None, False
        for pdf in batches:
            keys = pdf[key]
            change = (keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())
            change.iloc[0] = True
            at = [*change.to_numpy().nonzero()[0].tolist(), len(pdf)]
            for a, b in zip(at, at[1:]):
                part = pdf.iloc[a:b]
                k = keys.iloc[a]
                if not started or not (k == now or pd.isna(k) and pd.isna(now)):
                    now, state, started = k, begin(k), True
                yield step(state, part)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
