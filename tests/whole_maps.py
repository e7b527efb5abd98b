"""Whole maps as single arrays: the plain versions that tiles and strips are held against."""

from __future__ import annotations

import numpy as np

from navprep.operators.grids import components


def gaussian(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of radius int(4 sigma + 0.5), edges reflected."""
    if sigma <= 0:
        return grid
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        n = grid.shape[axis]
        at = np.arange(-r, n + r) % (2 * n)  # d c b a | a b c d | d c b a
        x = np.take(grid, np.where(at < n, at, 2 * n - 1 - at), axis)
        grid = sum(w * np.take(x, np.arange(i, i + n), axis) for i, w in enumerate(k))
    return grid


def distance(mask: np.ndarray) -> np.ndarray | None:
    """Exact Euclidean distance of each cell to the nearest zero, in cells; None without a zero."""
    if mask.all():
        return None
    nx, ny = mask.shape
    far = float(nx + ny + 1) ** 2
    at = np.where(mask, np.inf, np.arange(nx, dtype=float)[:, None])
    up = np.arange(nx)[:, None] - np.maximum.accumulate(np.where(mask, -np.inf, np.arange(nx, dtype=float)[:, None]), 0)
    down = np.minimum.accumulate(at[::-1], 0)[::-1] - np.arange(nx)[:, None]
    column = np.minimum(np.minimum(up, down) ** 2, far)
    # d2[x, y] = min over y' of column[x, y'] + (y - y')^2, by offsets that can still win
    out = column.copy()
    for s in range(1, ny):
        if s * s > out.max():
            break
        out[:, s:] = np.minimum(out[:, s:], column[:, :-s] + s * s)
        out[:, :-s] = np.minimum(out[:, :-s], column[:, s:] + s * s)
    return np.sqrt(out)


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    if least <= 1:
        return mask
    label = components(mask)
    return mask & (np.bincount(label.reshape(-1))[label] >= least)


def clearance_cost(occupied: np.ndarray, voxel: float, radius: float, softness: float, power: float = 1.0) -> np.ndarray:
    if radius <= 0 or not occupied.any():
        return occupied.astype(float)
    d = distance(~occupied) * voxel
    if softness <= 0:
        out = (d <= radius).astype(float)
    else:
        out = (1 / (1 + np.exp(np.clip((d - radius) / softness, -60, 60)))) ** power
    return np.where(occupied, 1.0, out)



def smooth_occupancy(cells: np.ndarray, sigma: float) -> np.ndarray:
    x = gaussian(cells.astype(float), sigma)
    return x / (x.max() + 1e-5)


def surface_layers(obstacle: np.ndarray, free: np.ndarray, corridor: np.ndarray, voxel: float, robot: float, sigma: float = 2.5, reassign: float = 0.3, least_free: float = 0.7) -> np.ndarray:
    """Obstacles, spread by the robot's size, and the corridor decide the free space; its distance to free cells, smoothed by sigma, in logarithms."""
    obs = smooth_occupancy(obstacle, robot / voxel)
    obs[corridor] = 0.0
    layer = gaussian(np.where(free, 0.0, 1.0), sigma)
    layer = layer / layer.max() if layer.max() > 0 else layer
    layer[layer < least_free] = 0.0
    layer[obs > reassign] = 1.0
    layer[corridor] = 0.0
    d = distance(layer > 0)
    d = np.zeros(layer.shape) if d is None else d
    return np.log(gaussian(d, sigma) + 1.00001)


def dilate(mask: np.ndarray, cells: int) -> np.ndarray:
    """Cells within so many cells of one of mask."""
    if cells <= 0 or not mask.any():
        return mask
    d = distance(~mask)
    return d <= cells
