"""Folds in order over long logs: rows are sorted into ranges, and what the fold knew at a range's end is carried on, so that no task holds a key's log.

Only the first key of a range can go on from the range before. Its incoming state is found in one of two ways: a fold of few states is a table of where each
state leads, tables of ranges are composed, and one pass suffices; any other fold is run from what is known, and ranges whose incoming state has changed are
run again until none does. Both give what a fold from the first row to the last gives.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .tables import stored

#: fold(rows of one key in order, state) -> (one result for each row, as columns, state). States are values that JSON holds.
Fold = Callable[[pd.DataFrame, Any], tuple[dict[str, np.ndarray], Any]]


def ranges(rows: DataFrame, key: str, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """rows (stored) with _part, a range in order of key, order, and _at, the row's place in it."""
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    x = stored(rows, "fold-rows").repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return stored(x.withColumn("_part", F.shiftright("_at", 33)), "fold-ranges")


def numbered(rows: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """rows with number: their place in order over all of them, from 0. Ranges count their rows; no task holds all."""
    x = ranges(rows, order[0], order[1:], parts)
    spans = x.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.join(F.broadcast(spans.select("_part", "_first", before.alias("_before"))), "_part")
    return x.withColumn("number", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _by_key(pdf: pd.DataFrame, key: str):
    """(key, rows) of a range, keys in order."""
    pdf = pdf.sort_values("_at")
    values = pdf[key].to_numpy()
    same = (values[1:] == values[:-1]) | (pd.isna(values[1:]) & pd.isna(values[:-1]))
    at = np.flatnonzero(np.r_[True, ~same, True]) if len(values) else np.zeros(0, int)
    for i, j in zip(at[:-1], at[1:]):
        yield pdf.iloc[i:j]


def _name(value: Any) -> str | None:
    return None if pd.isna(value) else str(value)


def ordered_fold(rows: DataFrame, key: str, order: Sequence[str], fold: Fold, start: Any, schema: str, keep: Sequence[str], states: Sequence[Any] | None = None, parts: int | None = None) -> DataFrame:
    """keep columns of rows and the fold's results (typed by schema) for each row; each key's fold begins with start.

    states: all states that the fold can be in, if they are few; then ranges are composed as tables. Rows of equal order are folded in no stated order; an
    empty table gives an empty result. The driver holds the states of as many keys as there are ranges, two for each."""
    at = ranges(rows, key, order, parts)
    known = None if states is None else {json.dumps(s): i for i, s in enumerate(states)}

    def ends(carry: dict[int, str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            part, out = int(pdf["_part"].iloc[0]), []
            groups = list(_by_key(pdf, key))
            for i, own in enumerate(groups):
                first, last = i == 0, i == len(groups) - 1
                if not (first or last):
                    continue
                if known is not None and first:
                    end = [known[json.dumps(fold(own, s)[1])] for s in states]
                else:
                    end = fold(own, json.loads(carry[part]) if first and part in carry else start)[1]
                out.append((part, i, _name(own[key].iloc[0]), last, json.dumps(end)))
            return pd.DataFrame(out, columns=["part", "i", "name", "last", "end"])

        return run

    def passed(which: DataFrame, carry: dict[int, str]) -> pd.DataFrame:
        return which.groupBy("_part").applyInPandas(ends(carry), "part long, i long, name string, last boolean, end string").toPandas()

    carry: dict[int, str] = {}
    found = passed(at, carry)
    while True:
        new = {}
        before: tuple | None = None  # the range before: its last key and that key's state
        for part, own in found.sort_values(["part", "i"]).groupby("part"):
            head, tail = own.iloc[0], own.iloc[-1]
            goes_on = before is not None and (before[0] == head["name"] or (before[0] is None and pd.isna(head["name"])))
            if goes_on:
                new[int(part)] = before[1]
            end = tail["end"]
            if known is not None and head["last"]:
                end = json.dumps(states[json.loads(head["end"])[known[before[1] if goes_on else json.dumps(start)]]])
            before = (None if pd.isna(tail["name"]) else tail["name"], end)
        if known is not None or new == carry:
            carry = new
            break
        again = [p for p in set(new) | set(carry) if new.get(p) != carry.get(p)]
        carry = new
        redone = passed(at.where(F.col("_part").isin(again)), carry)
        found = pd.concat([found[~found["part"].isin(again)], redone])
    names = [f.split()[0] for f in schema.split(", ")]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.select(*keep).schema)

    def results(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = int(pdf["_part"].iloc[0]), []
        for i, own in enumerate(_by_key(pdf, key)):
            got, _ = fold(own, json.loads(carry[part]) if i == 0 and part in carry else start)
            out.append(own[list(keep)].assign(**{n: got[n] for n in names}))
        return pd.concat(out)

    return at.groupBy("_part").applyInPandas(results, f"{types}, {schema}")
