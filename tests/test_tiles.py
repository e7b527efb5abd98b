"""Tiles, strips and merged labels against whole maps, and outliers against all distances."""

import numpy as np
import pandas as pd
import pytest
import whole_maps as whole
from pyspark.sql import functions as F

from navprep.operators import grids, outliers, tiles

SIZES = {"a": (37, 23), "b": (5, 61), "c": (16, 16), "d": (1, 1), "e": (40, 40)}


def params(spark, voxel=0.1):
    return spark.createDataFrame([(e, nx, ny, 0.0, 0.0, voxel) for e, (nx, ny) in SIZES.items()], "env string, num_x int, num_y int, start_x double, start_y double, voxel double")


def sparse(spark, masks, **more):
    rows = [pd.DataFrame({"env": e, "ix": np.nonzero(m)[0], "iy": np.nonzero(m)[1], **{k: v[e][m] for k, v in more.items()}}) for e, m in masks.items()]
    return spark.createDataFrame(pd.concat(rows)).withColumn("ix", F.col("ix").cast("int"))


def scene(seed, share):
    r = np.random.default_rng(seed)
    return {e: r.random(s) < share for e, s in SIZES.items()}


def grid(rows, env, column="value"):
    own = rows[rows["env"] == env]
    out = np.full(SIZES[env], np.nan)
    out[own["ix"], own["iy"]] = own[column]
    return out


@pytest.mark.parametrize("side", [7, 16, 256])
def test_gaussian_and_distance(spark, side):
    r = np.random.default_rng(1)
    masks = scene(0, 0.05)
    masks["d"][:] = False  # an env without a cell: smoothed to 0, no distance
    masks["e"][:] = False
    masks["e"][3, 39] = True
    values = {e: r.random(s) for e, s in SIZES.items()}
    cells = sparse(spark, masks, value=values)
    got = grids.gaussian_cells(cells, params(spark), 2.5, side).toPandas()
    for e, m in masks.items():
        assert np.allclose(grid(got, e), whole.gaussian(np.where(m, values[e], 0.0), 2.5))
    got = grids.distance_cells(cells, params(spark), side).toPandas()
    assert len(got) == sum(m.size for m in masks.values() if m.any())
    for e, m in masks.items():
        if m.any():
            assert np.allclose(grid(got, e), whole.distance(~m))


@pytest.mark.parametrize("side", [7, 256])
def test_surface_maps(spark, side):
    layer = {k: scene(i, share) for i, (k, share) in enumerate({"obstacle": 0.03, "free": 0.4, "corridor": 0.02}.items())}
    layer["obstacle"]["d"][:] = True
    layer["free"]["b"][:] = True
    rows = pd.concat([pd.DataFrame({"env": e, "ix": np.nonzero(m)[0].astype(np.int32), "iy": np.nonzero(m)[1].astype(np.int32), "layer": k}) for k, masks in layer.items() for e, m in masks.items()])
    got = grids.surface_map(spark.createDataFrame(rows), params(spark), robot=0.2, sigma=1.5, side=side).toPandas()
    assert len(got) == sum(a * b for a, b in SIZES.values())
    for e in SIZES:
        assert np.allclose(grid(got, e), whole.surface_layers(*(layer[k][e] for k in ("obstacle", "free", "corridor")), 0.1, 0.2, 1.5))


@pytest.mark.parametrize("side,reach,least,inflation,softness", [(7, 0.25, 3, 0.2, 0.1), (16, 0.0, 1, 0.0, 0.0), (256, 0.15, 2, 0.1, 0.1)])
def test_raycast_maps(spark, side, reach, least, inflation, softness):
    occupied, free = scene(4, 0.15), scene(5, 0.1)
    free["c"][:] = False  # without evidence nothing is thinned
    occupied["b"][:] = False
    both = {e: occupied[e] | free[e] for e in SIZES}
    got = grids.raycast_map(sparse(spark, both, occupied=occupied, free=free), params(spark), 0.3, softness, 0.4, least, 1.0, inflation, 1.5, reach, side).toPandas()
    assert len(got) == sum(a * b for a, b in SIZES.values())
    for e in SIZES:
        o, f = occupied[e], free[e]
        if reach > 0 and f.any():
            o = o & (whole.distance(~f) * 0.1 <= reach)
        o = whole.dilate(whole.drop_small(o, least), round(inflation / 0.1))
        cost = np.maximum(np.where(o | f, 0.0, 0.4), whole.clearance_cost(o, 0.1, 0.3, softness, 1.5))
        assert np.allclose(grid(got, e), np.clip(whole.gaussian(cost, 1.0), 0, 1))
        assert (grid(got, e, "state") == np.where(o, 2, np.where(f, 1, 0))).all()


@pytest.mark.parametrize("side", [5, 16, 256])
def test_components_across_tiles(spark, side):
    masks = scene(6, 0.6)
    snake = np.zeros(SIZES["e"], bool)  # one chain through every tile, there and back
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks["e"] = snake
    masks["d"][:] = False
    got = grids.component_cells(sparse(spark, masks), params(spark), side).toPandas()
    assert len(got) == sum(m.sum() for m in masks.values())
    for e, m in masks.items():
        label = grids.components(m)
        size = np.bincount(label.reshape(-1))[label]
        assert np.array_equal(grid(got, e, "label")[m], label[m] - 1) and np.array_equal(grid(got, e, "size")[m], size[m])
    assert got[got["env"] == "e"]["label"].nunique() == 1


def test_envelope_of_long_lines():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 31, 32, 33, 200):
        f = r.integers(0, 400, (9, n)) ** 2
        i = np.arange(n)
        assert (tiles.lower_envelope(f) == (f[:, None] + (i[:, None] - i[None]) ** 2).min(2)).all()


def test_maps_of_no_env(spark):
    none = params(spark).where("false")
    cells = spark.createDataFrame([], "env string, ix int, iy int, value double, layer string, occupied boolean, free boolean")
    for out in (grids.distance_cells(cells, none), grids.gaussian_cells(cells, none, 1.0), grids.surface_map(cells, none), grids.component_cells(cells, none), grids.raycast_map(cells, none, 0.3, 0.1, 0.3, 2, 1.0, 0.1, 1.0, 0.2)):
        assert out.collect() == []


def plain_outliers(p, k, ratio):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    mean = np.sort(d, 1)[:, :k].mean(1)
    above = mean[mean > 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        most = mean.sum() / len(mean) + ratio * np.sqrt(((above - mean.sum() / len(mean)) ** 2).sum() / (len(mean) - 1))
    return p[(mean > 0) & (mean < most)]


@pytest.mark.parametrize("k,spacing", [(50, 0.1), (5, 0.05), (20, 3.0)])
def test_outliers_equal_all_distances(spark, k, spacing):
    r = np.random.default_rng(3)
    clouds = {
        "sheet": np.c_[r.uniform(0, 4, (600, 2)), r.normal(0, 0.02, 600)],
        "far": np.r_[r.normal(0, 0.3, (200, 3)), [[30.0, -40.0, 5.0]], [[31.0, -40.0, 5.0]]],
        "few": r.random((7, 3)),
        "one": np.zeros((1, 3)),
        "same": np.ones((5, 3)),
        "apart": np.r_[r.normal(0, 0.1, (80, 3)), r.normal(20, 0.1, (80, 3))],
    }
    rows = pd.concat([pd.DataFrame({"env": e, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "home": "h", "id": 1}) for e, p in clouds.items()])
    rows = pd.concat([rows, pd.DataFrame({"env": "few", "x": [np.nan], "y": [0.0], "z": [0.0], "home": "h", "id": 1})])
    got = outliers.remove_outliers(spark.createDataFrame(rows), spacing, k).toPandas()
    assert set(got.columns) == set(rows.columns)
    for e, p in clouds.items():
        want = plain_outliers(p, min(k, len(p)), 2.0)
        have = got[got["env"] == e][["x", "y", "z"]].to_numpy()
        assert sorted(map(tuple, have)) == sorted(map(tuple, want)), e
    assert not len(got[got["env"].isin(["one", "same"])]) and len(got[got["env"] == "far"]) < 202


def test_no_outliers_without_points(spark):
    assert outliers.remove_outliers(spark.createDataFrame([], "env string, x double, y double, z double"), 0.1).collect() == []
