"""Shapes of segments: hulls, outlines, lines, and areas filled or convex."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.joins import shuffled
from ..functions.store import Scratch
from . import neighbourhood as nb
from .segmentation import KEY, fill_holes


def _kinds(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys)


#: Rows that a task gathers, of several segments or of one, before it works on them.
HELD = 1 << 16


def _by_segment(rows: DataFrame, keys: list[str], values: list[str], order: list[str], work: Callable[..., list[np.ndarray]], out: dict[str, type]) -> DataFrame:
    """Rows (keys, out) of what work makes of each segment's values, in their order; a task takes many segments at a time."""

    def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        of = table.column("_of").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        columns = [table.column(v).to_numpy() for v in values]
        found = [work(*(x[a:b] for x in columns)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        own = pa.array(np.repeat(edge[:-1], [len(x[0]) for x in found]))
        made = {k: np.concatenate([x[i] for x in found]).astype(t) for i, (k, t) in enumerate(out.items())}
        yield from pa.table({k: table.column(k).take(own) for k in keys} | made).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > HELD:  # the last segment may go on
                table = pa.Table.from_batches(held)
                of = table.column("_of").to_numpy()
                other = np.flatnonzero(of != of[-1])
                end = int(other[-1]) + 1 if len(other) else 0
                if end:
                    yield from worked(table.slice(0, end))
                held = table.slice(end).to_batches()
        if sum(map(len, held)):
            yield from worked(pa.Table.from_batches(held))

    dealt = rows.select(*keys, *values, F.xxhash64(*keys).alias("_of")).repartition(*keys).sortWithinPartitions(*keys, *order)
    names = {np.int32: "int", np.float64: "double"}
    return dealt.mapInArrow(run, f"{_kinds(rows, keys)}, " + ", ".join(f"{k} {names[t]}" for k, t in out.items()))


def _turns(points: list[tuple[float, float]]) -> np.ndarray:
    """The lower chain of the hull of points in order."""
    out: list[tuple[float, float]] = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return np.array(out)


def hull_rows(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, r, lo, hi): columns lo to hi of row r lie in the hull of the middles of the segment's pixel edges.

    Only the ends of each row reach the hull's chain, so a segment of n rows is
    2n numbers.
    """
    ends = mask.groupBy(*keys, "r").agg(F.min("c").cast("int").alias("lo"), F.max("c").cast("int").alias("hi")).withColumn("r", F.col("r").cast("int"))

    def hull(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        r, lo, hi = (x.astype(float) for x in (r, lo, hi))
        low = _turns(sorted([*zip(r, lo - 0.5), *zip(r - 0.5, lo), *zip(r + 0.5, lo)]))
        high = _turns(sorted([*zip(r, -hi - 0.5), *zip(r - 0.5, -hi), *zip(r + 0.5, -hi)]))
        at = np.arange(r[0], r[-1] + 1)
        return [at, np.ceil(np.interp(at, *low.T) - 1e-9), np.floor(1e-9 - np.interp(at, *high.T))]

    return _by_segment(ends, keys, ["r", "lo", "hi"], ["r"], hull, {"r": np.int32, "lo": np.int32, "hi": np.int32})


def convex_hull(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, r, c) of each segment's hull."""
    return hull_rows(mask, keys).where("hi >= lo").select(*keys, "r", F.explode(F.sequence("lo", "hi")).alias("c"))


def framed(mask: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each segment as an image of its own, with a border of one pixel: (image_id, r, c), image_id being its keys, and the images' sizes."""
    box = mask.groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    name = F.struct(*keys).alias(KEY)
    images = box.select(name, (F.col("r1") - F.col("r0") + 3).cast("int").alias("height"), (F.col("c1") - F.col("c0") + 3).cast("int").alias("width"))
    own = mask.select(*keys, "r", "c").join(shuffled(box), keys).select(name, (F.col("r") - F.col("r0") + 1).cast("int").alias("r"), (F.col("c") - F.col("c0") + 1).cast("int").alias("c"))
    return own, images


def filled(mask: DataFrame, keys: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Rows (image_id, r, c) of `framed` segments without holes."""
    return fill_holes(*framed(mask, keys), scratch)


def outline_length(mask: DataFrame) -> DataFrame:
    """Rows (image_id, points): points of the closed contour half-way between foreground and background of framed segments without holes."""
    out = mask.select(KEY, "r", "c", F.explode(nb._offsets([(0, 1), (1, 0), (0, -1), (-1, 0)])).alias("o")).select(KEY, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    return out.join(shuffled(mask.select(KEY, "r", "c")), [KEY, "r", "c"], "left_anti").groupBy(KEY).agg((F.count("*") + 1).alias("points"))


def shape_properties(mask: DataFrame, keys: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Rows (keys, area, convex_area, filled_area)."""
    area = mask.groupBy(*keys).agg(F.count("*").alias("area"))
    convex = hull_rows(mask, keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("convex_area"))
    full = filled(mask, keys, scratch).groupBy(KEY).agg(F.count("*").alias("filled_area")).select(f"{KEY}.*", "filled_area")
    return area.join(shuffled(convex), keys).join(shuffled(full), keys)


#: Up, right, down, left.
_WAYS = ((-1, 0), (0, 1), (1, 0), (0, -1))


def _walk(inside: dict[tuple[int, int], float], level: float) -> list[list[tuple[float, float]]]:
    """Closed contours at level around the pixels above it, clockwise; what isn't listed is 0.

    A step goes from one edge between inside and outside to the next, keeping
    the inside to the right; pixels that touch at corners alone are apart.
    """
    high = {p for p, v in inside.items() if v > level}
    left = sorted((p, d) for p in high for d in range(4) if (p[0] + _WAYS[d][0], p[1] + _WAYS[d][1]) not in high)
    seen, out = set(), []
    for start in left:
        if start in seen:
            continue
        (p, d), contour = start, []
        while (p, d) not in seen:
            seen.add((p, d))
            v = inside.get((p[0] + _WAYS[d][0], p[1] + _WAYS[d][1]), 0.0)
            share = (inside[p] - level) / (inside[p] - v)
            contour.append((p[0] + share * _WAYS[d][0], p[1] + share * _WAYS[d][1]))
            e = (d + 1) % 4
            q = (p[0] + _WAYS[e][0], p[1] + _WAYS[e][1])
            s = (q[0] + _WAYS[d][0], q[1] + _WAYS[d][1])
            p, d = (p, e) if q not in high else (q, d) if s not in high else (s, (d - 1) % 4)
        out.append([*contour, contour[0]])
    return out


def contours(values: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Rows (keys, contour, i, y, x): points of the contours of (keys, r, c, v) at level, in order, the first again at the end.

    A segment's pixels are walked in one task; segments are dealt by key.
    """

    def trace(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        found = _walk(dict(zip(zip(r.tolist(), c.tolist(), strict=True), v.tolist(), strict=True)), level)
        points = [(k, i, y, x) for k, contour in enumerate(found) for i, (y, x) in enumerate(contour)]
        return list(np.array(points, float).reshape(-1, 4).T)

    rows = values.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    return _by_segment(rows, keys, ["r", "c", "v"], ["r", "c"], trace, {"contour": np.int32, "i": np.int32, "y": np.float64, "x": np.float64})


def line(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """Array of (r, c) on the straight line between two pixels, both ends included."""
    n = F.greatest(F.abs(r1 - r0), F.abs(c1 - c0))
    at = lambda a, b, i: F.when(n == 0, a).otherwise(a + F.floor((2 * i * (b - a) + n) / (2 * F.greatest(n, F.lit(1))))).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(at(r0, r1, i).alias("r"), at(c0, c1, i).alias("c")))


@F.pandas_udf(LongType())
def _common_divisor(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def line_totals(rows: DataFrame, r0: str, c0: str, r1: str, c1: str) -> DataFrame:
    """Rows with the number of pixels of `line` between their ends, and the sums of those pixels' rows and columns (n, rows, cols).

    Steps i and n - i along an axis add up to its whole length d, and to one
    more where both are rounded up from a half, so no pixel is listed.
    """
    dr, dc = F.col(r1).cast("long") - F.col(r0), F.col(c1).cast("long") - F.col(c0)
    rows = rows.withColumns({"_dr": dr, "_dc": dc, "_n": F.greatest(F.abs(dr), F.abs(dc)), "_m": F.least(F.abs(dr), F.abs(dc))})
    rows = rows.withColumn("_g", _common_divisor(F.coalesce("_n", F.lit(0)), F.coalesce("_m", F.lit(0))))
    # the longer axis has no halves; the shorter has one in each of g equal parts of the line, if such a part has an even length
    halves = F.when((F.col("_g") > 0) & (F.expr("_n div greatest(_g, 1)") % 2 == 0), F.col("_g")).otherwise(0)
    total = lambda start, d: ((F.col("_n") + 1) * (2 * F.col(start) + F.col(d)) + F.when(F.abs(d) == F.col("_m"), halves).otherwise(0)) / 2
    return rows.withColumns({"n": F.col("_n") + 1, "rows": total(r0, "_dr").cast("long"), "cols": total(c0, "_dc").cast("long")}).drop("_dr", "_dc", "_n", "_m", "_g")
