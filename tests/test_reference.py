"""Queries against their oracles, and helpers against brute force."""

import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
import whole_maps

from navprep.jobs.catalog import ORACLES, QUERIES
from navprep.operators import grids, points, scoring, sync
from navprep.streaming import live_sync as live, robot

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    return ("nan" if math.isnan(v) else round(float(v), 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    if name.startswith("map_from"):  # over a million cells
        key = ["env", "ix", "iy"]
        got, want = (x.sort_values(key, ignore_index=True) for x in (df.toPandas(), db.sql(ORACLES[name]).df()))
        assert len(got) and (got[key].astype({"env": str}) == want[key].astype({"env": str})).all().all() and np.abs(got["value"] - want["value"]).max() <= 2e-6
        return
    got = sorted(repr(tuple(norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    want = db.sql(ORACLES[name])
    names = list(want.columns)
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(repr(tuple(norm(r[names.index(c)]) for c in sorted(names))) for r in want.fetchall())


def test_distance_field_full(spark):
    """Every cell of every map at the map's own resolution, from all its occupied cells."""
    from navprep.jobs.catalog import _BOUNDS

    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    cells = db.sql(_BOUNDS + " SELECT DISTINCT env, ix, iy, num_x, num_y FROM ok").df()
    got = QUERIES["distance_field_full"](spark, SF).toPandas()
    assert set(got["env"]) == set(cells["env"])
    for env, own in cells.groupby("env"):
        nx, ny = int(own["num_x"].iloc[0]), int(own["num_y"].iloc[0])
        o, g = own[["ix", "iy"]].to_numpy(), got[got["env"] == env].sort_values(["ix", "iy"])
        at = np.stack(np.indices((nx, ny)), -1).reshape(-1, 2)
        assert (g[["ix", "iy"]].to_numpy() == at).all()
        want = np.concatenate([((at[i : i + 4096, None] - o[None]) ** 2).sum(2).min(1) for i in range(0, len(at), 4096)])
        assert np.allclose(g["value"] ** 2, want)


def messages(spark, rows):
    return spark.createDataFrame(rows, "bag string, topic string, msg_idx long, stamp long")


def test_sync_ties(spark):
    rows = [("a", "cloud", 0, 100), ("a", "odom", 0, 90), ("a", "odom", 1, 110), ("a", "odom", 2, 110), ("a", "depth", 0, 80), ("a", "depth", 1, 80), ("a", "color", 0, 300)]
    slops = {"odom": 10, "depth": 20, "color": 5}
    r = sync.nearest_sync(messages(spark, rows), slops).first()
    # the later of two equally far, its first message; the last of equal ones before; distances equal to the slop pass
    assert (r.odom_idx, r.odom_dt, r.depth_idx, r.depth_dt, r.color_idx, r.drop_reason) == (1, 10, 1, -20, None, None)
    long = sync.nearest_sync(messages(spark, rows), slops, stretch=30).first()
    assert (long.odom_idx, long.depth_idx, long.color_idx, long.drop_reason) == (1, 1, None, None)
    assert sync.nearest_sync(messages(spark, rows[:1]), slops).first().drop_reason == "odom_missing"
    assert sync.nearest_sync(messages(spark, []), slops).count() == 0


@pytest.mark.parametrize("stretch", [None, 7, 400])
def test_sync_stretches(spark, stretch):
    """Any cut into stretches gives the nearest messages of the whole bag, near or far, missing topics among them."""
    rng, slops = np.random.default_rng(5), {"odom": 20, "depth": 30, "color": 10}
    counts = {"a": (40, 30, 20), "b": (3, 0, 5), "c": (0, 9, 9)}
    rows = [(bag, t, i, int(rng.integers(-200, 3000))) for bag, n in counts.items() for t, k in zip(("cloud", *sync.OTHERS), (30, *n)) for i in range(k)]
    want = {}
    for bag, _, i, at in (r for r in rows if r[1] == "cloud"):
        near = {}
        for t in sync.OTHERS:
            own = [(stamp - at, k) for b, topic, k, stamp in rows if (b, topic) == (bag, t)]
            near[t] = min((max((x for x in own if x[0] < 0), default=None), min((x for x in own if x[0] >= 0), default=None)), key=lambda x: (x is None, abs(x[0]) if x else 0, x is not None and x[0] < 0))
        late = [why for t in ("odom", "depth") for why, bad in ((f"{t}_missing", near[t] is None), (f"{t}_slop", near[t] and abs(near[t][0]) > slops[t])) if bad]
        if near["color"] and abs(near["color"][0]) > slops["color"]:
            near["color"] = None
        want[bag, i] = (*(near[t] and near[t][1] for t in sync.OTHERS), *(near[t] and near[t][0] for t in sync.OTHERS), late[0] if late else None)
    got = sync.nearest_sync(messages(spark, rows), slops, stretch).collect()
    assert {(r.bag, r.cloud_idx): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_pick_topic(spark):
    rows = [("a", "p", 0, 1), ("a", "f", 0, 2), ("b", "f", 0, 3), ("b", "odom", 0, 3)]
    got = {(r.bag, r.topic, r.stamp) for r in sync.pick_topic(messages(spark, rows), "p", "f").collect()}
    assert got == {("a", "cloud", 1), ("b", "cloud", 3), ("b", "odom", 3)}


def test_distance_components_gaussian():
    r = np.random.default_rng(0)
    for _ in range(5):
        mask = r.random((17, 13)) < 0.8
        zero = np.argwhere(~mask)
        want = np.sqrt(((np.argwhere(np.ones_like(mask))[:, None] - zero[None]) ** 2).sum(2).min(1)).reshape(mask.shape)
        assert np.allclose(whole_maps.distance(mask), want)
        label = grids.components(mask)
        for x, y in zip(*np.nonzero(mask)):
            for u, v in ((x + 1, y), (x, y + 1)):
                if u < 17 and v < 13 and mask[u, v]:
                    assert label[x, y] == label[u, v]
    assert len(np.unique(grids.components(np.array([[1, 0], [0, 1]], bool)))) == 3
    assert whole_maps.distance(np.ones((2, 2), bool)) is None
    g = np.zeros((9, 9))
    g[0, 4] = 1
    s, k = whole_maps.gaussian(g, 1.0), np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    k /= k.sum()
    assert np.isclose(s[0, 4], (k[4] + k[3]) * k[4]) and np.isclose(s.sum(), 1)
    assert whole_maps.drop_small(np.array([[1, 1, 0, 1]], bool), 2).tolist() == [[True, True, False, False]]


def test_bicubic_and_lookup(spark):
    r = np.random.default_rng(1)
    grid = r.random((40, 30))
    h = r.random((50, 2)) * (44, 34) - 2
    want = grids.bicubic(grid, h)
    assert np.isclose(grids.bicubic(grid, np.array([[5.5, 7.5]]))[0], grid[5, 7])
    ix, iy = np.indices(grid.shape)
    cells = spark.createDataFrame(pd.DataFrame({"env": "e", "ix": ix.reshape(-1), "iy": iy.reshape(-1), "value": grid.reshape(-1)}))
    params = spark.createDataFrame([("e", 40, 30, 0.0, 0.0, 1.0)], "env string, num_x int, num_y int, start_x double, start_y double, voxel double")
    wp = spark.createDataFrame(pd.DataFrame({"traj_id": np.arange(50), "wp_idx": np.zeros(50, np.int32), "env": "e", "wx": h[:, 0], "wy": h[:, 1]}))
    got = scoring.lookup(wp, cells, params, tile=8).toPandas().sort_values("traj_id")
    assert np.allclose(got["cost"], want)


def test_lines(spark):
    rays = spark.createDataFrame([("e", 0, 0, 0, 4, 6), ("e", 0, 0, 0, 4, 6), ("e", 0, 0, 0, 1, 0)], "env string, frame_id long, cx int, cy int, ix int, iy int")
    got = sorted((r.ix, r.iy) for r in points.ray_cells(rays, 0).collect())
    # step k of the longer axis: ceil(4 k / 6 - 1 / 2) along the shorter; the second ray is too short
    assert got == [(math.ceil(4 * k / 6 - 0.5), k) for k in range(7)]


def tick(state, fear=0.9, **more):
    return robot.step(state, "tick", fear, True, **more)


def test_planner_steps():
    assert tick(robot.START) == robot.START  # no plan without a goal
    goal = robot.step([2, True, -1, False, True], "goal", 0.0, False)
    assert goal == [0, False, 0, True, False]
    s = goal
    for _ in range(4):
        s = tick(s)
    assert s == [4, True, -1, True, False] and tick(s) == s  # fear ahead while reacting leaves the count alone
    assert tick(s, 0.1)[:3] == [3, True, -1]
    # an arrival stays one, whatever fear says, and no plan follows it
    late = [3, False, 0, True, False]
    arrived = tick(late, distance=0.4)
    assert arrived == [4, True, 1, False, False] and tick(arrived, 0.1) == arrived
    # in joystick mode nothing arrives; the button clears fear, the dead-band goal and fear
    joy = robot.step(late, "joy", 0.0, False, stick=(0.5, 0.0), pressed=True)
    assert joy == [0, False, 0, True, True] and tick(joy, distance=0.1)[2:] == [0, True, True]
    assert robot.step([2, False, 0, True, True], "joy", 0.0, False, stick=(0.01, 0.0)) == [0, False, 0, False, True]
    assert robot.step(late, "joy", 0.0, False, stick=None, pressed=True) == late and robot.step(late, "joy", 0.0, False, stick=(0.5, 0.5)) == late


KINDS = {"view": "tick", "signup": "goal", "purchase": "tick", "click": "joy"}


def planner_events(n, robots, seed=7):
    r = np.random.default_rng(seed)
    kinds = np.array(["view", "signup", "purchase", "click"])[r.choice(4, n, p=[0.75, 0.07, 0.06, 0.12])]
    return pd.DataFrame({
        "robot_id": np.where(r.random(n) < 0.8, 0, r.integers(0, robots, n)), "event_id": np.arange(n), "ts": (np.arange(n) + 9) * 400_000 + r.integers(0, 2, n) * 1000, "kind": [KINDS[k] for k in kinds],
        "fear": r.random(n) * 0.8 + 0.2, "forward": r.random(n) < 0.9, "distance": np.where(kinds == "purchase", 0.1, 4.0), "stick_x": r.normal(0, 0.5, n), "stick_y": r.normal(0, 0.5, n),
        "n_axes": np.where(r.random(n) < 0.9, 4, 1), "n_buttons": 2, "pressed": r.random(n) < 0.4,
    })


def folded(events):
    """Event by event, robot by robot."""
    out = []
    for _, own in events.sort_values(["ts", "event_id"]).groupby("robot_id"):
        state = robot.START
        for e in own.itertuples():
            stick = (e.stick_x, e.stick_y) if e.kind == "joy" and e.n_axes > 1 else None
            state = robot.step(state, e.kind, e.fear, e.forward, e.distance, stick, e.pressed)
            out.append((e.robot_id, e.event_id, *state))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 30])
def test_planner_fold_over_many_tasks(spark, parts):
    e = planner_events(300, 5)
    got = robot.fold_batch(spark.createDataFrame(e), parts=parts)
    want = folded(e)
    assert sorted(map(tuple, got.collect())) == want and any(x[3] for x in want) and any(x[4] == 1 for x in want)
    assert all(s[-5:] and list(s[2:]) in robot.all_states() for s in want)
    assert robot.fold_batch(spark.createDataFrame(e).limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 9, 30])
def test_folds_without_tables(spark, parts):
    r = np.random.default_rng(8)
    env = np.where(r.random(200) < 0.7, "a", np.where(r.random(200) < 0.5, "b", "c"))
    p = pd.DataFrame({"env": env, "frame_id": r.permutation(200), **{c: np.round(r.normal(0, 0.02, 200), 3) for c in ("x", "y", "z", "qx", "qy", "qz", "qw")}})
    want = []
    for e, own in p.sort_values("frame_id").groupby("env"):
        last, n = None, 0
        for row in own.itertuples():
            v = np.array(row[3:])
            if last is None or np.linalg.norm(v - last) >= 0.05:
                want.append((e, row.frame_id, n))
                last, n = v, n + 1
    assert sorted(map(tuple, robot.deduplicate_motion(spark.createDataFrame(p), 0.05, parts).collect())) == sorted(want)
    log = pd.DataFrame({"run": env, "epoch": np.arange(200), "val_loss": r.random(200)})
    want = []
    for e, own in log.groupby("run"):
        steps, _ = scoring.plateau_steps(own["val_loss"].tolist(), [None, 0, 1e-5, False])
        want += [(e, i, *s) for i, s in zip(own["epoch"], steps)]
    got = sorted(map(tuple, scoring.replay_schedule(spark.createDataFrame(log), 1e-5, parts).collect()))
    assert got == sorted(want) and any(x[3] for x in got)


def streamed(spark, tmp_path, rows, schema, run, batches=4):
    """run over a stream of rows in files, one a micro-batch; the last row moves the watermark past all others."""
    n = -(-len(rows) // batches)
    for i in range(batches):
        part = tmp_path / "in" / f"{i}"
        spark.createDataFrame(rows.iloc[i * n : i * n + n], schema).coalesce(1).write.parquet(str(part))
        os.utime(next(part.glob("part-*")), (i + 1, i + 1))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert len(q.recentProgress) >= batches
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(str(tmp_path / "out"))


def late(rows, by, seed=1):
    """rows out of order by less than `by` microseconds."""
    return rows.iloc[np.argsort(rows["ts"].to_numpy() + np.random.default_rng(seed).integers(0, by, len(rows)), kind="stable")]


def test_planner_stream_equals_batch(spark, tmp_path):
    """Rows late by less than the watermark allows, within and across micro-batches."""
    e = planner_events(160, 4)
    last = e.iloc[:1].assign(robot_id=99, event_id=9999, ts=10**9)
    out = streamed(spark, tmp_path, pd.concat([late(e, 6_000_000), last]), robot.EVENT, robot.fold_stream)
    got = sorted(map(tuple, out.where("robot_id < 99").collect()))
    assert got == folded(e) and any(x[3] for x in got)


def test_deduplication_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(4)
    p = pd.DataFrame({"env": np.where(r.random(120) < 0.7, "a", "b"), "ts": (np.arange(120) + 9) * 300_000, "frame_id": np.arange(120), **{c: np.round(r.normal(0, 0.02, 120), 3) for c in ("x", "y", "z", "qx", "qy", "qz", "qw")}})
    schema = "env string, ts long, frame_id long, x double, y double, z double, qx double, qy double, qz double, qw double"
    out = streamed(spark, tmp_path, pd.concat([late(p, 5_000_000), p.iloc[:1].assign(env="end", ts=10**9)]), schema, lambda s: robot.deduplicate_stream(s, near=0.05))
    want = robot.deduplicate_motion(spark.createDataFrame(p, schema), 0.05)
    assert sorted(map(tuple, out.where("env < 'c'").collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def live_matches(rows, slop, queue):
    """Message by message, every combination of the queues in order of nearness."""
    queues, out = {}, []
    for _, m in rows.sort_values(["ts", "msg_id", "topic"]).iterrows():
        own = queues.setdefault(m["robot_id"], {t: {} for t in live.TOPICS})
        own[m["topic"]][m["ts"]] = m["msg_id"]
        while len(own[m["topic"]]) > queue:
            del own[m["topic"]][min(own[m["topic"]])]
        sides = [[m["ts"]] if t == m["topic"] else sorted((s for s in own[t] if abs(s - m["ts"]) <= slop), key=lambda s: (abs(s - m["ts"]), s)) for t in live.TOPICS]
        for stamps in itertools.product(*sides):
            if max(stamps) - min(stamps) < slop and m["ts"] in own[m["topic"]]:
                out.append((m["robot_id"], m["ts"], *(own[t].pop(s) for t, s in zip(live.TOPICS, stamps))))
                break
    return sorted(out)


def topic_log(n, seed):
    r = np.random.default_rng(seed)
    topic = np.array([*live.TOPICS, "other"])[r.choice(5, n, p=[0.3, 0.3, 0.2, 0.15, 0.05])]
    return pd.DataFrame({"robot_id": np.where(r.random(n) < 0.7, 0, r.integers(0, 4, n)), "topic": topic, "ts": r.integers(1000, 41_000, n) * 1000, "msg_id": np.arange(n)})


@pytest.mark.parametrize("slop,queue,parts", [(300_000, 10, 1), (300_000, 2, 23), (2_000_000, 10, 30), (4_000_000, 3, 9)])
def test_live_sync(spark, slop, queue, parts):
    m = topic_log(400, slop % 7 + queue)
    want = live_matches(m[m["topic"] != "other"], slop, queue)
    got = live.live_sync(spark.createDataFrame(m), slop, queue=queue, parts=parts)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5
    if slop > 3_000_000:  # a queue that overflows loses matches
        assert want != live_matches(m[m["topic"] != "other"], slop, 10)


def test_live_sync_stream_equals_batch(spark, tmp_path):
    m = topic_log(240, 3)
    out = streamed(spark, tmp_path, pd.concat([late(m, 6_000_000), m.iloc[:1].assign(robot_id=99, ts=10**9)]), "robot_id long, topic string, ts long, msg_id long", lambda s: live.live_sync_stream(s, 2_000_000, "10 seconds", queue=4))
    got = sorted(map(tuple, out.where("robot_id < 99").collect()))
    assert got == live_matches(m[m["topic"] != "other"], 2_000_000, 4) and got


def test_plateau():
    run = lambda losses, lr: scoring.plateau_steps(losses, [None, 0, lr, False], patience=4)[0]
    assert run([1.0] * 7, 0.1)[5] == (0.05, False)
    # where the rate can't drop any more it stays, and training stops
    assert run([1.0] * 7, 1e-6)[4:6] == [(1e-6, False), (1e-6, True)]


def test_entry_without_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
