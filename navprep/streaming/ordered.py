"""Folds in order over streams: rows wait until the watermark has passed them, and are then folded in order, also across micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Fold


def _plain(row: tuple) -> tuple:
    return tuple(None if not isinstance(v, (list, dict)) and pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row)


class EventTimeFold(StatefulProcessor):
    """State of a key: the fold's, as JSON, and the rows that wait. Rows later than the watermark are dropped by Spark."""

    def __init__(self, fold: Fold, start: Any, rows: str, order: Sequence[str], keep: Sequence[str], results: Sequence[str]):
        self.fold, self.start, self.rows, self.order, self.keep, self.results = fold, start, rows, list(order), list(keep), list(results)
        self.names = [f.split()[0] for f in rows.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.pending = handle.getListState("pending", self.rows)

    def _wait(self, rows: pd.DataFrame) -> None:
        for row in rows[self.names].itertuples(index=False):
            self.pending.appendValue(_plain(row))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = -1
        for pdf in rows:
            self._wait(pdf)
            last = max(last, int(pdf["ts"].max()) // 1000)
        # by then all rows of this batch are due; a timer of an earlier batch may take some of them along
        self.handle.registerTimer(last + 1)
        yield pd.DataFrame(columns=[*self.keep, *self.results])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.pending.get()], columns=self.names)
        ready = (held["ts"] // 1000 < timerValues.getCurrentWatermarkInMs()).to_numpy(bool)
        due = held[ready].sort_values(self.order, kind="stable")
        if not len(due):
            return
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start
        got, state = self.fold(due, state)
        self.state.update((json.dumps(state),))
        self.pending.clear()
        self._wait(held[~ready])
        yield pd.DataFrame({**{c: due[c].to_numpy() for c in self.keep}, **{c: got[c] for c in self.results}})

    def close(self) -> None:
        pass


def fold_in_order(rows: DataFrame, key: str, order: Sequence[str], fold: Fold, start: Any, schema: str, keep: Sequence[str], lateness: str) -> DataFrame:
    """operators.folds.ordered_fold over a streaming DataFrame (append mode). rows carry ts in microseconds, the first of order; a row's result comes once the
    watermark, lateness behind the latest row, has passed it. Stamps are after 1970, where watermarks begin."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    waiting = ", ".join(f"{n} {t}" for n, t in types.items())
    out = ", ".join([*(f"{n} {types[n]}" for n in keep), schema])
    processor = EventTimeFold(fold, start, waiting, order, keep, [f.split()[0] for f in schema.split(", ")])
    timed = rows.withColumn("_at", F.timestamp_micros("ts")).withWatermark("_at", lateness)
    return timed.groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime")
