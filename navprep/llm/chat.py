"""Chat formatting with minimum-cost role repair: dynamic programming over an automaton of legal turns.

States: nothing yet, after a system, a user, an assistant turn. Legal: one system turn at most, first; then user and assistant in turn, user first,
assistant last. A turn is kept, merged into the one before, relabelled (and merged), or an empty turn of the missing role goes before it.
The least costs of a stretch of turns are a matrix in the (min, +) algebra, so stretches of a long conversation are solved apart and meet by matrix only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROLES = ("system", "user", "assistant")
#: Turn numbers that one stretch spans.
STRETCH = 256
MERGE, RELABEL, GUESS, INSERT = 1.0, 3.0, 1.5, 2.0
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # legal roles (1 system, 2 user, 3 assistant) after each state


def _moves(role: int) -> dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]:
    """(state, next state) -> (cost, action, inserted roles) for a turn of a role; 0: unknown. Among equal costs the first listed stands."""
    out: dict[tuple[int, int], tuple[float, str, tuple[int, ...]]] = {}

    def offer(s: int, to: int, cost: float, action: str, inserted: tuple[int, ...] = ()) -> None:
        if (s, to) not in out or cost < out[s, to][0]:
            out[s, to] = (cost, action, inserted)

    for s in range(4):
        for to in (1, 2, 3):
            change = 0.0 if role == to else GUESS if role == 0 else RELABEL
            kind = "" if role == to else "relabel"
            if to in _NEXT[s]:
                offer(s, to, change, kind or "keep")
            if s == to:
                offer(s, to, change + MERGE, "relabel+merge" if kind else "merge")
            for x in _NEXT[s]:
                if to in _NEXT[x]:
                    offer(s, to, change + INSERT, f"insert+{kind}" if kind else "insert", (x,))
    return out


MOVES = [_moves(r) for r in range(4)]
COSTS = np.full((4, 4, 4), np.inf)
for _r, _m in enumerate(MOVES):
    for (_s, _t), _x in _m.items():
        COSTS[_r, _s, _t] = _x[0]
#: Cost of ending in a state, and the turns inserted for it.
END = {0: (0.0, ()), 1: (2 * INSERT, (2, 3)), 2: (INSERT, (3,)), 3: (0.0, ())}


def role_number(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) + 1 if r in ROLES else 0


def stretch_matrix(roles: list[int]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        m = (m[:, :, None] + COSTS[r][None]).min(1)
    return m


def stretch_path(roles: list[int], entry: int, leave: int) -> list[int]:
    """States after each turn on the cheapest way from entry to leave; ties to the smaller state, from the end."""
    best = [np.where(np.arange(4) == entry, 0.0, np.inf)]
    for r in roles:
        best.append((best[-1][:, None] + COSTS[r]).min(0))
    path, s = [], leave
    for i in range(len(roles) - 1, -1, -1):
        path.append(s)
        s = int(np.argmin(best[i] + COSTS[roles[i]][:, s]))
    return path[::-1]


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    yield from ((k, list(g)) for k, g in groupby((r for b in batches for r in b.to_pylist()), lambda r: tuple(r[k] for k in keys)))


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ({"conv_id": c, "stretch": s, "m": stretch_matrix([role_number(t["role"]) for t in turns]).reshape(-1).tolist()} for (c, s), turns in _runs(batches, ("conv_id", "stretch")))
    yield from _batched(rows, pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("m", pa.list_(pa.float64()))]))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (c,), parts in _runs(batches, ("conv_id",)):
            best = [np.array([0.0, np.inf, np.inf, np.inf])]
            ms = [np.array(p["m"]).reshape(4, 4) for p in parts]
            for m in ms:
                best.append((best[-1][:, None] + m).min(0))
            total = best[-1] + np.array([END[s][0] for s in range(4)])
            s = int(np.argmin(total))
            for i in range(len(parts) - 1, -1, -1):
                entry = int(np.argmin(best[i] + ms[i][:, s]))
                yield {"conv_id": c, "stretch": parts[i]["stretch"], "entry": entry, "leave": s, "last": i == len(parts) - 1, "cost": float(total.min())}
                s = entry

    yield from _batched(rows(), pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.float64())]))


#: A mark of ours in a text, and as many backslashes as make it none.
_MARK = re.compile(r"<(\\*)\|(end|%s)\|>" % "|".join(ROLES))


def escaped(text: str) -> str:
    """text with a backslash more in each `<|role|>` or `<|end|>`, so that it can't be read as a turn; taking one away in each gives the text again."""
    return _MARK.sub(r"<\\\1|\2|>", text)


def _head(role: int, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{ROLES[role - 1]}|>\n"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (c, _), turns in _runs(batches, ("conv_id", "stretch")):
            roles, s = [role_number(t["role"]) for t in turns], turns[0]["entry"]
            for i, (t, to) in enumerate(zip(turns, stretch_path(roles, s, turns[0]["leave"]))):
                cost, action, inserted = MOVES[roles[i]][s, to]
                out, text = "", escaped(t["text"] or "")
                for x in inserted:
                    out += _head(x, s == 0 and not out)
                out += "\n" + text if "merge" in action else _head(to, s == 0 and not out) + text
                end = END[to][1] if t["last"] and i == len(turns) - 1 else ()
                if t["last"] and i == len(turns) - 1:
                    out += "".join(_head(x, False) for x in end) + "<|end|>\n"
                yield {"conv_id": c, "turn": t["turn"], "role": ROLES[to - 1], "action": action, "n_inserted": len(inserted) + len(end), "cost": cost + INSERT * len(end), "rendered": out}
                s = to

    yield from _batched(rows(), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("n_inserted", pa.int32()), ("cost", pa.float64()), ("rendered", pa.string())]))


def repair_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """conv_id, turn, role, action, n_inserted, cost, rendered for every turn. A conversation's rendered parts, joined in order, are the repaired chat.

    Turns stand in order of turn, then role, then text; a null turn comes last; a null or unknown role takes the cheapest legal one; a null text is
    empty, and marks of turns within one are escaped; turns without a conversation id are one conversation. Repeated rows are turns each. Conversations are dealt by stretches of turn numbers, so a
    long one is not in one task.
    """
    t = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    t = t.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / stretch), F.lit((1 << 63) - 1)).cast("long"))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    dealt = t.select("conv_id", "stretch", "turn", "role", "text").repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", *order)
    ms = dealt.mapInArrow(_matrices, "conv_id long, stretch long, m array<double>")
    ends = ms.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(_ends, "conv_id long, stretch long, entry int, leave int, last boolean, cost double")
    e = ends.select(F.col("conv_id").alias("e_id"), F.col("stretch").alias("e_stretch"), "entry", "leave", "last")
    both = t.join(e, F.col("conv_id").eqNullSafe(F.col("e_id")) & (F.col("stretch") == F.col("e_stretch"))).drop("e_id", "e_stretch")
    both = both.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", *order)
    return both.mapInArrow(_repaired, "conv_id long, turn long, role string, action string, n_inserted int, cost double, rendered string")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
