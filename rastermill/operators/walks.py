"""Segments by random walks from markers, and by merging neighbours in a graph."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contrast import blur

KEY = "image_id"


def _grid(rows: pd.DataFrame, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of one image from its own corner, and its values on a grid, NaN where there is no pixel."""
    r, c = rows["r"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
    r, c = r - r.min(), c - c.min()
    out = np.full((r.max() + 1, c.max() + 1), np.nan)
    out[r, c] = rows[value]
    return r, c, out


def _sides(a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of all pairs of neighbours below and beside each other."""
    return [(a[:-1], a[1:]), (a[:, :-1], a[:, 1:])]


def _harmonic(weights: list[np.ndarray], free: np.ndarray, fixed: np.ndarray, tolerance: float) -> np.ndarray:
    """Values that equal `fixed` outside `free` and elsewhere the weighted mean of their neighbours', by conjugate gradients."""

    def laplacian(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for w, (a, b), (p, q) in zip(weights, _sides(x), _sides(out), strict=True):
            flow = w * (a - b)
            p += flow
            q -= flow
        return np.where(free, out, 0.0)

    degree = np.zeros_like(fixed)
    for w, (p, q) in zip(weights, _sides(degree), strict=True):
        p += w
        q += w
    degree = np.where(degree > 0, degree, 1.0)
    x = np.where(free, 0.0, fixed)
    residual = -laplacian(x)
    step = z = residual / degree
    energy, least = (residual * z).sum(), tolerance**2 * max((residual * z).sum(), 1e-300)
    for turn in itertools.count():
        if energy <= least:
            break
        if turn > 100 + 10 * free.sum():  # exact sums need no more steps than free places
            raise ValueError("random walks did not converge")
        moved = laplacian(step)
        rate = energy / (step * moved).sum()
        x, residual = x + rate * step, residual - rate * moved
        z = residual / degree
        energy, before = (residual * z).sum(), energy
        step = z + energy / before * step
    return x


def random_walker(values: DataFrame, markers: DataFrame, beta: float = 130.0, tolerance: float = 1e-4) -> DataFrame:
    """Rows (image_id, r, c, segment): each pixel of values (image_id, r, c, v) gets the marker that a random walk from it most likely meets first.

    A walk crosses an edge with weight exp(-beta * difference^2 / (10 * the
    image's deviation)); of equal chances the smaller marker wins.  Images
    without markers give no rows.  An image is a task's work.
    """
    kind = dict(values.dtypes)[KEY]
    rows = values.select(KEY, "r", "c", "v").join(markers.select(KEY, "r", "c", "segment"), [KEY, "r", "c"], "left")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        r, c, v = _grid(rows, "v")
        names = sorted(rows["segment"].dropna().unique())
        if not names:
            return rows[[KEY, "r", "c", "segment"]].head(0).astype({"segment": object})
        marker = np.full(v.shape, -1)
        marker[r, c] = rows["segment"].map({n: k for k, n in enumerate(names)}).fillna(-1)
        spread = 10 * max(float(np.nanstd(v)), 1e-12)
        weights = [np.where(np.isnan(a - b), 0.0, np.exp(-beta * np.nan_to_num(a - b) ** 2 / spread) + 1e-10) for a, b in _sides(v)]
        best, label = np.full(v.shape, -np.inf), np.zeros(v.shape, int)
        for k in range(len(names)):
            chance = _harmonic(weights, (marker < 0) & ~np.isnan(v), (marker == k).astype(float), tolerance)
            better = chance > best + 1e-9
            best, label = np.where(better, chance, best), np.where(better, k, label)
        return pd.DataFrame({KEY: rows[KEY], "r": rows["r"], "c": rows["c"], "segment": np.array(names, object)[label[r, c]]})

    return rows.groupBy(KEY).applyInPandas(walk, f"{KEY} {kind}, r int, c int, segment string")


def graph_segments(values: DataFrame, scale: float = 100.0, sigma: float = 0.5, min_size: int = 50) -> DataFrame:
    """Rows (image_id, r, c, segment): neighbours of values (image_id, r, c, v) merge while they differ little (after Felzenszwalb and Huttenlocher).

    Values in [0, 1] are blurred by sigma; edges between the eight neighbours
    are taken by rising difference, and join two segments if it is below each
    one's largest so far plus scale / 255 by its size.  Segments below min_size
    then join a neighbour.  segment is its least pixel in row order, as "r-c".
    An image is a task's work.
    """
    kind = dict(values.dtypes)[KEY]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "c"], ignore_index=True)
        r, c, v = _grid(rows, "v")
        number = np.full(v.shape, -1)
        number[r, c] = np.arange(len(rows))
        edges = []
        for a, b in [*_sides(number), (number[:-1, :-1], number[1:, 1:]), (number[:-1, 1:], number[1:, :-1])]:
            both = (a >= 0) & (b >= 0)
            edges.append(np.stack([a[both], b[both]]))
        a, b = np.concatenate(edges, 1)
        value = rows["v"].to_numpy(float)
        cost = np.abs(value[a] - value[b])
        order = np.lexsort((b, a, cost))
        parent, size, inside = list(range(len(rows))), [1] * len(rows), [0.0] * len(rows)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def join(x: int, y: int, difference: float) -> None:
            x, y = min(x, y), max(x, y)
            parent[y] = x
            size[x] += size[y]
            inside[x] = difference

        edges = list(zip(a[order].tolist(), b[order].tolist(), cost[order].tolist(), strict=True))
        for x, y, d in edges:
            x, y = root(x), root(y)
            if x != y and d < min(inside[x] + scale / 255 / size[x], inside[y] + scale / 255 / size[y]):
                join(x, y, d)
        for x, y, d in edges:
            x, y = root(x), root(y)
            if x != y and min(size[x], size[y]) < min_size:
                join(x, y, d)
        first = np.array([root(k) for k in range(len(rows))])
        names = np.array([f"{x}-{y}" for x, y in zip(rows["r"].tolist(), rows["c"].tolist(), strict=True)], object)
        return pd.DataFrame({KEY: rows[KEY], "r": rows["r"], "c": rows["c"], "segment": names[first]})

    smooth = blur(values, sigma) if sigma > 0 else values
    return smooth.select(KEY, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v").groupBy(KEY).applyInPandas(merge, f"{KEY} {kind}, r int, c int, segment string")
