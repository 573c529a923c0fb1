"""Segments of masks: components, holes, markers and watersheds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.store import Scratch
from . import neighbourhood as nb
from .graph import connected_components

KEY = nb.KEY
#: Pixels of an image that one task labels at most; larger images are labelled as graphs over many tasks.
MOST_PIXELS = 1 << 22
#: Pixels of an image that one task floods at most, and the side of the tiles of larger images.
MOST_FLOODED, TILE = 1 << 20, 512
#: Pixels that a task gathers, of several images or of one, before it labels them.
HELD = 1 << 17


def _label(neighbours: int, level: str | None):
    """Labels of images that come one after another, each in row order: runs along rows, joined where they touch in the next row."""

    def labelled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        image, r, c = (rows.column(k).to_numpy().astype(np.int64) for k in ("_image", "r", "c"))
        kind = rows.column(level).to_numpy() if level else np.zeros(len(rows))
        nth = np.concatenate([[0], np.cumsum(image[1:] != image[:-1])])
        line = nth * (r.max() - r.min() + 2) + r - r.min()
        width = c.max() - c.min() + 3
        place = line * width + c - c.min() + 1
        of = np.concatenate([[0], np.cumsum((np.diff(place) != 1) | (kind[1:] != kind[:-1]))])
        edges = []
        for d in (-1, 0, 1) if neighbours == 8 else (0,):
            below = np.minimum(np.searchsorted(place, place + width + d), len(place) - 1)
            touch = (place[below] == place + width + d) & (kind[below] == kind)
            edges.append(np.stack([of[touch], of[below[touch]]]))
        a, b = np.unique(np.concatenate(edges, 1), axis=1)
        label = np.arange(of[-1] + 1)
        while len(a) and (label[a] != label[b]).any():
            least = np.minimum(label[a], label[b])
            for end in (label[a], label[b]):  # the roots of both ends go to the lesser one
                np.minimum.at(label, end, least)
            while (label != label[label]).any():
                label = label[label]
        first = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))[label]
        names = np.array([f"{x}-{y}" for x, y in zip(r[first].tolist(), c[first].tolist(), strict=True)], object)
        yield from pa.table({KEY: rows.column(KEY), "r": rows.column("r"), "c": rows.column("c"), "segment": pa.array(names[of], pa.string())}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > HELD:  # the last image may go on
                rows = pa.Table.from_batches(held)
                image = rows.column("_image").to_numpy()
                end = int(np.flatnonzero(image != image[-1])[-1]) + 1 if (image != image[-1]).any() else 0
                if end:
                    yield from labelled(rows.slice(0, end))
                held = rows.slice(end).to_batches()
        if sum(map(len, held)):
            yield from labelled(pa.Table.from_batches(held))

    return run


def components(mask: DataFrame, neighbours: int = 8, scratch: Scratch | None = None, level: str | None = None) -> DataFrame:
    """Rows (image_id, r, c, segment): segment is its least pixel in row order, as "r-c".

    neighbours is 4 or 8.  With level, only neighbours of equal level belong
    together.  Images of up to MOST_PIXELS foreground pixels are labelled whole,
    many by a task.  Of larger ones, runs of pixels along rows are nodes and those
    that touch in the next row edges of one graph over all images, so a large
    image is no one task's work; labels are the same.
    """
    scratch = scratch or Scratch(mask.sparkSession, "components")
    same = [level] if level else []
    mask = scratch.save(mask.select(KEY, "r", "c", *same).distinct(), "mask")
    large = scratch.save(mask.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > MOST_PIXELS).select(KEY), "large")
    some = not large.isEmpty()
    small = mask.join(large, KEY, "left_anti") if some else mask
    types = dict(mask.dtypes)
    dealt = small.withColumn("_image", F.xxhash64(KEY)).repartition(KEY).sortWithinPartitions(KEY, "r", "c")
    out = dealt.mapInArrow(_label(neighbours, level), f"{KEY} {types[KEY]}, r {types['r']}, c {types['c']}, segment string")
    return out.unionByName(_graph_components(mask.join(large, KEY, "left_semi"), neighbours, scratch, same)) if some else out


def _graph_components(mask: DataFrame, neighbours: int, scratch: Scratch, same: list[str]) -> DataFrame:
    """Components of images of any size, by one graph over all of them."""
    along = Window.partitionBy(KEY, "r", *same)
    mask = mask.withColumn("island", F.col("c") - F.row_number().over(along.orderBy("c")))
    mask = scratch.save(mask.withColumn("start", F.min("c").over(Window.partitionBy(KEY, "r", *same, "island"))).drop("island"), "runs")
    node = lambda r, c: F.struct(F.col(KEY), F.col(r).alias("r"), F.col(c).alias("c"))
    moved = mask.select(KEY, *same, F.col("r").alias("r0"), F.col("start").alias("start0"), (F.col("r") + 1).alias("r"), F.explode(F.array(*[F.col("c") + d for d in ((-1, 0, 1) if neighbours == 8 else (0,))])).alias("c"))
    edges = moved.join(mask, [KEY, "r", "c", *same]).select(node("r0", "start0").alias("u"), node("r", "start").alias("v"))
    found = connected_components(edges, scratch, "runs")
    labelled = mask.withColumn("node", node("r", "start")).join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    return labelled.select(KEY, "r", "c", F.concat_ws("-", F.col("root.r").cast("string"), F.col("root.c").cast("string")).alias("segment"))


def fill_holes(mask: DataFrame, images: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The mask with all background that isn't 4-connected to the image's border."""
    grid = images.select(KEY, "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    ground = components(grid.join(shuffled(mask.select(KEY, "r", "c")), [KEY, "r", "c"], "left_anti"), 4, scratch)
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("height") - 1) | (F.col("c") == F.col("width") - 1)
    outer = nb.with_sizes(images, ground).where(edge).select(KEY, "segment").distinct()
    holes = ground.join(shuffled(outer), [KEY, "segment"], "left_anti").select(KEY, "r", "c")
    return mask.select(KEY, "r", "c").unionByName(holes).distinct()


def adaptive_markers(mask: DataFrame, images: DataFrame, factors: tuple[int, int, int] = (9, 5, 1), small: int = 200, medium: int = 800, scratch: Scratch | None = None) -> DataFrame:
    """Rows (image_id, r, c, segment): each segment eroded by a disk, smaller for small segments, and less where nothing would be left.

    factors are those of large, medium and small segments.  A disk of radius n
    fits at a pixel whose nearest background is farther than n, so one distance
    transform serves all radii.
    """
    labelled = components(mask, 8, scratch)
    far = labelled.join(shuffled(nb.squared_distances(mask, images)), [KEY, "r", "c"]).withColumn("d2", F.coalesce("d2", F.lit(1 << 40)))
    by = far.groupBy(KEY, "segment").agg(F.count("*").alias("size"), F.max("d2").alias("most"))
    wanted = F.when(F.col("size") <= small, factors[2]).when(F.col("size") <= medium, factors[1]).otherwise(factors[0])
    by = by.select(KEY, "segment", F.least(wanted, F.ceil(F.sqrt("most")) - 1).cast("long").alias("n"))
    return far.join(shuffled(by), [KEY, "segment"]).where(F.col("d2") > F.col("n") * F.col("n")).select(KEY, "r", "c", "segment")


_FLOODED = "m double, d long, label string"


def _flood(rows: pd.DataFrame) -> pd.DataFrame:
    """Values (m, d, label) of one image's or tile's pixels; rows of other tiles (not own) keep the values they come with.

    The way from a marker to a pixel costs m, the highest level on it, and d,
    its steps since that level was reached; a pixel takes the least of its
    neighbours' ways one step on, of equal ones that of the smaller label.
    """
    rows = rows.sort_values(["r", "c"], ignore_index=True)
    r, c = rows["r"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
    width = int(c.max() - c.min()) + 3  # a border of places outside
    place = ((r - r.min() + 1) * width + c - c.min() + 1).tolist()
    size = place[-1] + 2 * width
    level: list = [None] * size
    best: list = [None] * size
    heap, own = [], rows["own"].tolist()
    for p, mine, v, marker, m, d, label in zip(place, own, rows["level"].tolist(), rows["marker"].tolist(), rows["m"].tolist(), rows["d"].tolist(), rows["label"].tolist(), strict=True):
        if not mine:
            if label is not None:
                heap.append((m, int(d), label, p))
        else:
            level[p] = v
            if marker is not None:
                heap.append((v, 0, marker, p))
    for m, d, label, p in heap:
        best[p] = (m, d, label)
    heapq.heapify(heap)
    fixed = {p for _, _, _, p in heap}
    while heap:
        m, d, label, p = heapq.heappop(heap)
        if best[p] < (m, d, label):
            continue
        for q in (p - width, p - 1, p + 1, p + width):
            v = level[q]
            if v is not None and q not in fixed:
                way = (v, 0, label) if v > m else (m, d + 1, label)
                if best[q] is None or way < best[q]:
                    best[q] = way
                    heapq.heappush(heap, (*way, q))
    found = [best[p] or (None, None, None) for p, mine in zip(place, own, strict=True) if mine]
    out = rows[rows["own"]]
    m, d, label = zip(*found, strict=True) if found else ((), (), ())
    before = zip(out["m"].tolist(), out["d"].tolist(), out["label"].tolist(), strict=True)
    changed = [x[2] is not None and x != w or (x[2] is None) != (w[2] is None) for x, w in zip(found, before, strict=True)]
    return pd.DataFrame({KEY: out[KEY], "r": out["r"].astype("int32"), "c": out["c"].astype("int32"), "level": out["level"], "marker": out["marker"], "m": np.array(m, float), "d": pd.array(d, "Int64"), "label": np.array(label, object), "changed": changed})


def watershed(mask: DataFrame, levels: DataFrame, markers: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (image_id, r, c, segment): markers (image_id, r, c, segment) flooded over the mask by rising level (image_id, r, c, v).

    A pixel goes to the marker from which the highest level on the way is
    least; of equal ones to that of the fewest steps since that level, then to
    the smaller marker.  Pixels that no marker reaches give no row.  Images of
    up to MOST_FLOODED pixels are flooded whole.  Larger ones are flooded in
    tiles, each from the values that border it, in rounds until no value
    changes; each round is saved, and rows are the same.
    """
    scratch = scratch or Scratch(mask.sparkSession, "watershed")
    kind = dict(mask.dtypes)[KEY]
    rows = mask.select(KEY, "r", "c").distinct().join(shuffled(levels.select(KEY, "r", "c", F.col("v").cast("double").alias("level"))), [KEY, "r", "c"])
    rows = rows.join(shuffled(markers.select(KEY, "r", "c", F.col("segment").cast("string").alias("marker"))), [KEY, "r", "c"], "left")
    rows = scratch.save(rows.withColumns({"m": F.lit(None).cast("double"), "d": F.lit(None).cast("long"), "label": F.lit(None).cast("string")}), "levels")
    large = scratch.save(rows.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > MOST_FLOODED).select(KEY), "large")
    schema = f"{KEY} {kind}, r int, c int, level double, marker string, {_FLOODED}, changed boolean"
    small = rows.join(large, KEY, "left_anti").withColumn("own", F.lit(True)).groupBy(KEY).applyInPandas(_flood, schema)
    out = small.where("label is not null").select(KEY, "r", "c", F.col("label").alias("segment"))
    if large.isEmpty():
        return out
    state = rows.join(large, KEY, "left_semi").withColumn("changed", F.lit(True))
    place = lambda x, k: F.floor((F.col(x) + k) / TILE).cast("int")
    while True:
        # a pixel beside another tile lies in both, with the values it has
        beside = [F.struct(place("r", a).alias("tr"), place("c", b).alias("tc")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]
        seen = state.drop("changed").withColumn("tile", F.explode(F.array_distinct(F.array(*beside))))
        seen = seen.withColumn("own", (F.col("tile.tr") == place("r", 0)) & (F.col("tile.tc") == place("c", 0)))
        state = scratch.save(seen.groupBy(KEY, "tile").applyInPandas(lambda x: _flood(x.drop(columns="tile")), schema), "round")
        if state.where("changed").isEmpty():
            return out.unionByName(state.where("label is not null").select(KEY, "r", "c", F.col("label").alias("segment")))


def segment(mask: DataFrame, images: DataFrame, method: str = "watershed", factors: tuple[int, int, int] = (9, 5, 1), low: int = 0, high: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Segments (image_id, r, c, segment) of a mask with low < size < high (default: the image's pixels).

    watershed floods the negative distance transform from adaptive markers;
    random_walker takes the same markers, graph merges the mask's pixels, and
    both keep the mask's foreground; connected takes components.
    """
    from . import walks

    if method == "connected":
        out = components(mask, 8, scratch)
    elif method == "watershed":
        levels = nb.squared_distances(mask, images).select(KEY, "r", "c", (-F.sqrt(F.coalesce("d2", F.lit(0)))).alias("v"))
        out = watershed(mask, levels, adaptive_markers(mask, images, factors, scratch=scratch), scratch)
    elif method in ("random_walker", "graph"):
        here = mask.select(KEY, "r", "c").distinct()
        grid = images.select(KEY, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r")).select(KEY, "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
        values = grid.join(shuffled(here.withColumn("v", F.lit(1.0))), [KEY, "r", "c"], "left").fillna(0.0, ["v"])
        found = walks.graph_segments(values) if method == "graph" else walks.random_walker(values, adaptive_markers(mask, images, factors, scratch=scratch))
        out = found.join(shuffled(here), [KEY, "r", "c"], "left_semi")
    else:
        raise ValueError(f"unknown segmentation: {method}")
    sizes = out.groupBy(KEY, "segment").agg(F.count("*").alias("size")).join(shuffled(images), KEY)
    kept = sizes.where((F.col("size") > low) & (F.col("size") < (F.col("height") * F.col("width") if high is None else F.lit(high)))).select(KEY, "segment")
    return out.join(shuffled(kept), [KEY, "segment"], "left_semi").select(KEY, "r", "c", "segment")


def center_candidates(mask: DataFrame, images: DataFrame, disk: int = 10, small: int = 5, distance: int = 3) -> DataFrame:
    """Centres from peaks of distances inside the opened mask, and inside its opened top-hat."""
    opened = nb.opening(mask, images, disk)
    hat = nb.opening(mask.select(KEY, "r", "c").distinct().join(opened, [KEY, "r", "c"], "left_anti"), images, small)
    peaks = [nb.local_maxima(nb.squared_distances(m, images).select(KEY, "r", "c", F.sqrt("d2").alias("v")), images, distance, 0.0).select(KEY, "r", "c") for m in (opened, hat)]
    return peaks[0].unionByName(peaks[1]).distinct()


def closest_pixels(mask: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """The pixel of each segment nearest to (center_r, center_c), first in row order among equals, with its squared distance."""
    d2 = (F.col("r") - F.col("center_r")) ** 2 + (F.col("c") - F.col("center_c")) ** 2
    best = mask.join(centers, keys).groupBy(*keys).agg(F.min(F.struct(d2.alias("d2"), "r", "c")).alias("x"))
    return best.select(*keys, "x.r", "x.c", "x.d2")


def region_properties(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centroid and the diameter of the circle of equal area."""
    out = mask.groupBy(*keys).agg(F.count("*").alias("area"), F.avg("r").alias("centroid_r"), F.avg("c").alias("centroid_c"))
    return out.withColumn("equivalent_diameter", F.sqrt(4 * F.col("area") / F.pi()))
