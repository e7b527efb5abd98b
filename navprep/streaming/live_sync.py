"""Live synchronisation of several topics by approximate time, with bounded queues: in batches over logs and over streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.folds import ordered_fold
from .ordered import fold_in_order

TOPICS = ("cloud", "odom", "depth", "color")
QUEUE = 10


def _nearest_set(stamps: list[list[int]], low: int, high: int, slop: int) -> list[int] | None:
    """A place in each list, the earlier ones nearest first, so that all stamps, low and high lie within less than slop."""
    if not stamps:
        return []
    for i, t in enumerate(stamps[0]):
        lo, hi = min(low, t), max(high, t)
        if hi - lo < slop:
            rest = _nearest_set(stamps[1:], lo, hi, slop)
            if rest is not None:
                return [i, *rest]
    return None


def take(state: list, topic: int, ts: int, msg: int, slop: int, queue: int = QUEUE) -> tuple[list[int] | None, list]:
    """(messages of all topics that the new one completes, or None, queues). state: for each topic up to queue [stamp, message], the oldest gone first.

    A message is matched with one of every other topic at most slop away; nearer ones are tried first, topic by topic, until all lie within less than slop. The
    matched leave their queues. A message whose stamp its topic's queue holds replaces it."""
    queues = [list(q) for q in state]
    queues[topic] = sorted([*(m for m in queues[topic] if m[0] != ts), [ts, msg]])[-queue:]
    if [ts, msg] not in queues[topic]:  # older than a full queue
        return None, queues
    near = [sorted((m for m in q if abs(m[0] - ts) <= slop), key=lambda m: (abs(m[0] - ts), m[0])) for q in queues]
    near[topic] = [[ts, msg]]
    found = _nearest_set([[m[0] for m in n] for n in near], ts, ts, slop)
    if found is None:
        return None, queues
    match = [n[i] for n, i in zip(near, found)]
    return [m[1] for m in match], [[m for m in q if m != own] for q, own in zip(queues, match)]


def _fold(topics: Sequence[str], slop: int, queue: int):
    def fold(rows: pd.DataFrame, state: list) -> tuple[dict, list]:
        ids = np.full((len(rows), len(topics)), -1, np.int64)
        for i, (topic, ts, msg) in enumerate(zip(rows["topic"], rows["ts"], rows["msg_id"])):
            match, state = take(state, topics.index(topic), int(ts), int(msg), slop, queue)
            if match:
                ids[i] = match
        return {"matched": ids[:, 0] >= 0, **{t: ids[:, k] for k, t in enumerate(topics)}}, state

    return fold


def _input(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    m = messages.select("robot_id", "topic", F.col("ts").cast("long").alias("ts"), F.col("msg_id").cast("long").alias("msg_id"))
    return m.where(F.col("topic").isin(*topics) & F.col("ts").isNotNull() & (F.col("msg_id") >= 0))


def _results(topics: Sequence[str]) -> str:
    return ", ".join(["matched boolean", *(f"{t} long" for t in topics)])


def live_sync(messages: DataFrame, slop: int, topics: Sequence[str] = TOPICS, queue: int = QUEUE, parts: int | None = None) -> DataFrame:
    """robot_id, ts, and each topic's msg_id of every match; messages: robot_id, topic, ts (microseconds), msg_id (from 0), taken in order of ts, msg_id and topic.

    ts is the stamp of the message that completed the match. Messages of other topics, or without a stamp, take no part. Queues carry on over tasks."""
    out = ordered_fold(_input(messages, topics), "robot_id", ["ts", "msg_id", "topic"], _fold(topics, slop, queue), [[] for _ in topics], _results(topics), ["robot_id", "ts"], parts=parts)
    return out.where("matched").drop("matched")


def live_sync_stream(messages: DataFrame, slop: int, lateness: str, topics: Sequence[str] = TOPICS, queue: int = QUEUE) -> DataFrame:
    """live_sync over a streaming DataFrame: messages wait for the watermark, so their order across micro-batches is that of their stamps."""
    out = fold_in_order(_input(messages, topics), "robot_id", ["ts", "msg_id", "topic"], _fold(topics, slop, queue), [[] for _ in topics], _results(topics), ["robot_id", "ts"], lateness)
    return out.where("matched").drop("matched")
