"""Queries over windows, padding, neighbourhood features and augmentation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import neighbourhood as nb
from ..operators import sampling, statistics, tiling
from . import views as v


def _images(spark, sf_dir):
    px = v.px64(spark, sf_dir)
    return px, v.dims(px)


def train_windows_labeled(spark, sf_dir):
    px, images = _images(spark, sf_dir)
    rows = tiling.label_windows(tiling.training_windows(images, (16, 16), 6), v.above(px, 0.9), 1)
    name = tiling.window_name(F.when(F.col("is_positive") == "1", "pos").otherwise("neg"), "image_id", "row_min", "col_min")
    return rows.select(name.alias("filename"), F.col("image_id").alias("parent_image_id"), "extract_height", "extract_width", F.col("height").alias("image_height"), F.col("width").alias("image_width"), "index_row", "index_col", "is_positive")


def relabel_center_compat(spark, sf_dir):
    px, images = _images(spark, sf_dir)
    rows = tiling.label_windows(tiling.training_windows(images, (16, 16), 6), v.above(px, 0.9), 1, half_open=True)
    return rows.select("image_id", "index_row", "index_col", "is_positive")


def infer_windows(spark, sf_dir):
    return tiling.inference_windows(_images(spark, sf_dir)[1], (16, 16), (3, 3))


def infer_windows_compat(spark, sf_dir):
    return tiling.inference_windows(_images(spark, sf_dir)[1], (16, 16), (3, 3), pad=False, compat=True)


def scored_windows(spark, sf_dir):
    return v.boxes(spark, sf_dir)


def boxes_to_mask(spark, sf_dir):
    _, images = _images(spark, sf_dir)
    return tiling.boxes_to_mask(v.boxes(spark, sf_dir).where("score > 0"), images, (3, 3))


def boxes_to_values(spark, sf_dir):
    _, images = _images(spark, sf_dir)
    return tiling.boxes_to_mask(v.boxes(spark, sf_dir).where("score > 0"), images, (5, 5), value="score")


def roi_recrop_from_parent(spark, sf_dir):
    px, images = _images(spark, sf_dir)
    rois = tiling.training_windows(images, (16, 16), 6).withColumnRenamed("image_id", "parent_image_id")
    rows = tiling.recrop(rois, statistics.rescale(px, ["image_id"]))
    return rows.groupBy("parent_image_id", "index_row", "index_col").agg(F.count("v").alias("n"), F.round(F.sum("v"), 6).alias("total"))


def _padded(kind):
    def query(spark, sf_dir):
        px = v.px8(spark, sf_dir)
        return tiling.pad_images(px, v.dims(px), (4, 4), kind).withColumn("v", F.round("v", 6))

    return query


def negatives_far_from_centers(spark, sf_dir):
    px, images = _images(spark, sf_dir)
    return sampling.negatives(images, v.above(px, 0.98).select("image_id", "r", "c"), (16, 16), 5, 3)


def roi_batch(spark, sf_dir):
    px, images = _images(spark, sf_dir)
    return sampling.roi_batch(v.tiles(v.above(px, 0.97)), images, (16, 16), 2, 3)


def endless_batches(spark, sf_dir):
    return sampling.endless_batches(v.read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 32, 50)


def gaussian_hadamard(spark, sf_dir):
    return nb.gaussian_features(v.px8(spark, sf_dir), 8, 8, (1.0, 2.0, 4.0)).withColumn("feature", F.round("feature", 6))


def sobel(spark, sf_dir):
    return nb.sobel(*_images(spark, sf_dir)).withColumn("v", F.round("v", 6))


def centered_gradient(spark, sf_dir):
    return nb.centered_gradient(v.px64(spark, sf_dir)).withColumns({k: F.round(k, 6) for k in ("gx", "gy")})


def hog_cells(spark, sf_dir):
    return nb.hog_cells(*_images(spark, sf_dir)).withColumn("total", F.round("total", 6))


def hog_blocks(spark, sf_dir):
    return nb.hog_blocks(nb.hog_cells(*_images(spark, sf_dir))).withColumn("value", F.round("value", 6))


def augment(spark, sf_dir):
    px = v.px8(spark, sf_dir)
    return sampling.augment(px, v.dims(px)).withColumn("v", F.round("v", 6))


def _kernel_values() -> str:
    return ", ".join(f"(CAST({s} AS DOUBLE), {r}, {c}, {w!r})" for s in (1.0, 2.0, 4.0) for r, c, w in nb.gaussian_kernel(8, 8, s))


_STARTS = "st AS (SELECT unnest(range(0, 48, 8)) AS s)"
_TRAIN = f"WITH {v.PX64}, {v.above_sql('hot', 0.9)}, im AS (SELECT DISTINCT image_id FROM px64), {_STARTS}, w AS (SELECT image_id, CAST(a.s AS INT) AS row_min, CAST(b.s AS INT) AS col_min, CAST(a.s + 8 AS INT) AS index_row, CAST(b.s + 8 AS INT) AS index_col FROM im, st a, st b)"
_HIT = "CASE WHEN EXISTS (SELECT 1 FROM hot h WHERE h.image_id = w.image_id AND h.r BETWEEN index_row - 1 AND index_row + {0} AND h.c BETWEEN index_col - 1 AND index_col + {0}) THEN '1' ELSE '0' END"
_PADDED = f"WITH {v.PX8}, im AS (SELECT DISTINCT image_id FROM px8), g AS (SELECT image_id, CAST(a AS INT) AS r, CAST(b AS INT) AS c FROM im, (SELECT unnest(range(0, 12)) AS a), (SELECT unnest(range(0, 12)) AS b))"
_REFLECT = {"reflect": "CASE WHEN {0} < 2 THEN 2 - {0} WHEN {0} > 9 THEN 14 - ({0} - 2) ELSE {0} - 2 END", "symmetric": "CASE WHEN {0} < 2 THEN 1 - {0} WHEN {0} > 9 THEN 15 - ({0} - 2) ELSE {0} - 2 END", "edge": "least(greatest({0} - 2, 0), 7)"}
_GRAD = f"WITH {v.PX64}, g AS (SELECT image_id, r, c, coalesce(lag(v) OVER x, v) - coalesce(lead(v) OVER x, v) AS gx, coalesce(lag(v) OVER y, v) - coalesce(lead(v) OVER y, v) AS gy FROM px64 WINDOW x AS (PARTITION BY image_id, r ORDER BY c), y AS (PARTITION BY image_id, c ORDER BY r))"
_HOG = f"""{_GRAD}, o AS (SELECT *, CASE WHEN gy < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END AS a, sqrt(gx * gx + gy * gy) AS m FROM g),
s AS (SELECT image_id, CAST(r // 8 AS INT) AS cr, CAST(c // 8 AS INT) AS cc, CAST(least(floor(a / {math.pi / 9!r}), 8) AS INT) AS bin, sum(m) AS total FROM o GROUP BY 1, 2, 3, 4),
cells AS (SELECT i.image_id, CAST(a AS INT) AS cr, CAST(b AS INT) AS cc, CAST(k AS INT) AS bin, coalesce(total, 0) AS total FROM (SELECT DISTINCT image_id FROM px64) i, (SELECT unnest(range(0, 8)) AS a), (SELECT unnest(range(0, 8)) AS b), (SELECT unnest(range(0, 9)) AS k) LEFT JOIN s ON s.image_id = i.image_id AND s.cr = a AND s.cc = b AND s.bin = k)"""
_BOXES = f"WITH {v.PX64}, {v.BOXES}"

_ROI = f"""WITH {v.PX64}, {v.above_sql('hot', 0.97)}, {v.tiles_sql('tiled', 'hot')}, mid AS (SELECT image_id, mask_id, (max(r) + min(r)) // 2 AS r, (max(c) + min(c)) // 2 AS c FROM tiled GROUP BY 1, 2),
g AS (SELECT DISTINCT image_id, CAST(a AS INT) AS r, CAST(b AS INT) AS c FROM px64, (SELECT unnest(range(7, 56)) AS a), (SELECT unnest(range(7, 56)) AS b)), f AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM mid h WHERE h.image_id = g.image_id AND abs(h.r - g.r) + abs(h.c - g.c) <= 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(image_id || '-' || r || '-' || c || '-100'), r, c) AS nth FROM f),
every AS (SELECT image_id, concat_ws('_', 'pos', image_id, mask_id) AS filename, r, c, '1' AS is_positive FROM mid UNION ALL
  SELECT image_id, concat_ws('_', 'neg', image_id, lpad(CAST(nth AS VARCHAR), 5, '0')), r, c, '0' FROM n JOIN (SELECT image_id, 2 * count(*) AS wanted FROM mid GROUP BY 1) USING (image_id) WHERE nth <= wanted)
SELECT filename, image_id AS parent_image_id, 16 AS extract_height, 16 AS extract_width, 64 AS image_height, 64 AS image_width, r AS index_row, c AS index_col, is_positive FROM every"""
_ENDLESS = """WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS nth, count(*) OVER () AS n FROM labels),
d AS (SELECT i // 32 AS batch, i % 32 AS place, ('0x' || substr(md5(i || '-1'), 1, 12))::BIGINT % (SELECT count(*) FROM labels) + 1 AS nth FROM (SELECT unnest(range(0, 1600)) AS i))
SELECT doc_id, batch, place FROM d JOIN k USING (nth)"""

QUERIES = {
    "roi_batch": (roi_batch, _ROI),
    "endless_batches": (endless_batches, _ENDLESS),
    "train_windows_labeled": (train_windows_labeled, f"{_TRAIN}, l AS (SELECT *, {_HIT.format(1)} AS is_positive FROM w) SELECT concat_ws('_', CASE WHEN is_positive = '1' THEN 'pos' ELSE 'neg' END, image_id, row_min, col_min) AS filename, image_id AS parent_image_id, 16 AS extract_height, 16 AS extract_width, 64 AS image_height, 64 AS image_width, index_row, index_col, is_positive FROM l"),
    "relabel_center_compat": (relabel_center_compat, f"{_TRAIN} SELECT image_id, index_row, index_col, {_HIT.format(0)} AS is_positive FROM w"),
    "infer_windows": (infer_windows, f"WITH {v.PX64}, st AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k FROM (SELECT unnest(range(0, 65, 3)) AS s UNION SELECT 64)) SELECT i.image_id, CAST(b.k * (SELECT count(*) FROM st) + a.k AS INT) AS ordinal, CAST(a.s - 8 AS INT) AS anchor_r, CAST(b.s - 8 AS INT) AS anchor_c, 16 AS window_h, 16 AS window_w FROM (SELECT DISTINCT image_id FROM px64) i, st a, st b"),
    "infer_windows_compat": (infer_windows_compat, f"WITH {v.PX64}, st AS (SELECT s, k FROM (SELECT unnest(range(0, 49, 3)) AS s, unnest(range(0, 17)) AS k) UNION ALL SELECT 48, 17) SELECT i.image_id, CAST(b.k * 18 + a.k AS INT) AS ordinal, CAST(a.s AS INT) AS anchor_r, CAST(b.s AS INT) AS anchor_c, 16 AS window_h, 16 AS window_w FROM (SELECT DISTINCT image_id FROM px64) i, st a, st b"),
    "scored_windows": (scored_windows, f"{_BOXES} SELECT image_id, ordinal, anchor_r, anchor_c, 16 AS window_h, 16 AS window_w, score FROM boxes"),
    "boxes_to_mask": (boxes_to_mask, f"{_BOXES}, d AS (SELECT unnest(range(0, 3)) AS d) SELECT DISTINCT image_id, CAST(greatest(0, anchor_r + 7) + a.d AS INT) AS r, CAST(greatest(0, anchor_c + 7) + b.d AS INT) AS c FROM boxes, d a, d b WHERE score > 0 AND anchor_r + 7 + a.d < 63 AND anchor_c + 7 + b.d < 63"),
    "boxes_to_values": (boxes_to_values, f"{_BOXES}, d AS (SELECT unnest(range(0, 5)) AS d) SELECT image_id, r, c, arg_max(score, ordinal) AS v FROM (SELECT image_id, ordinal, score, CAST(anchor_r + 7 + a.d AS INT) AS r, CAST(anchor_c + 7 + b.d AS INT) AS c FROM boxes, d a, d b WHERE score > 0 AND anchor_r + 7 + a.d < 63 AND anchor_c + 7 + b.d < 63) GROUP BY 1, 2, 3"),
    "roi_recrop_from_parent": (roi_recrop_from_parent, f"{_TRAIN}, span AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px64 GROUP BY 1) SELECT w.image_id AS parent_image_id, index_row, index_col, count(p.v) AS n, round(sum((p.v - lo) / (hi - lo)), 6) AS total FROM w JOIN span USING (image_id) LEFT JOIN px64 p ON p.image_id = w.image_id AND p.r BETWEEN row_min + 1 AND row_min + 16 AND p.c BETWEEN col_min + 1 AND col_min + 16 GROUP BY 1, 2, 3"),
    "pad_median": (_padded("constant"), f"{_PADDED}, md AS (SELECT image_id, median(v) AS m FROM px8 GROUP BY 1) SELECT g.image_id, g.r, g.c, round(coalesce(p.v, m), 6) AS v FROM g JOIN md USING (image_id) LEFT JOIN px8 p ON p.image_id = g.image_id AND p.r = g.r - 2 AND p.c = g.c - 2"),
    **{f"pad_{kind}": (_padded(kind), f"{_PADDED} SELECT g.image_id, g.r, g.c, round(p.v, 6) AS v FROM g JOIN px8 p ON p.image_id = g.image_id AND p.r = {e.format('g.r')} AND p.c = {e.format('g.c')}") for kind, e in _REFLECT.items()},
    "negatives_far_from_centers": (negatives_far_from_centers, f"WITH {v.PX64}, {v.above_sql('hot', 0.98)}, g AS (SELECT DISTINCT image_id, CAST(a AS INT) AS r, CAST(b AS INT) AS c FROM px64, (SELECT unnest(range(7, 56)) AS a), (SELECT unnest(range(7, 56)) AS b)), f AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.image_id = g.image_id AND abs(h.r - g.r) + abs(h.c - g.c) <= 3)) SELECT image_id, r AS center_r, c AS center_c FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(image_id || '-' || r || '-' || c || '-100'), r, c) AS nth FROM f) WHERE nth <= 5"),
    "gaussian_hadamard": (gaussian_hadamard, f"WITH {v.PX8}, k(sigma, r, c, w) AS (VALUES {_kernel_values()}) SELECT image_id, sigma, round(sum(v * w), 6) AS feature FROM px8 JOIN k USING (r, c) GROUP BY 1, 2"),
    "sobel": (sobel, f"""WITH {v.PX64}, n AS (SELECT p.image_id, p.r, p.c, sum(q.v * (q.r - p.r) * (2 - abs(q.c - p.c)) / 4) AS h, sum(q.v * (q.c - p.c) * (2 - abs(q.r - p.r)) / 4) AS x FROM px64 p JOIN px64 q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY 1, 2, 3)
SELECT image_id, r, c, CASE WHEN r IN (0, 63) OR c IN (0, 63) THEN 0 ELSE round(sqrt((h * h + x * x) / 2), 6) END AS v FROM n"""),
    "centered_gradient": (centered_gradient, f"{_GRAD} SELECT image_id, r, c, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g"),
    "hog_cells": (hog_cells, f"{_HOG} SELECT image_id, cr, cc, bin, round(total, 6) AS total FROM cells"),
    "hog_blocks": (hog_blocks, f"{_HOG}, d AS (SELECT unnest([0, 1]) AS d) SELECT image_id, CAST(cr - a.d AS INT) AS br, CAST(cc - b.d AS INT) AS bc, CAST((a.d * 2 + b.d) * 9 + bin AS INT) AS k, CASE WHEN cr - a.d < 6 AND cc - b.d < 6 THEN round(total / sqrt(total * total + 1), 6) ELSE 0 END AS value FROM cells, d a, d b WHERE cr - a.d BETWEEN 0 AND 6 AND cc - b.d BETWEEN 0 AND 6"),
    "augment": (augment, f"WITH {v.PX8}, w AS (SELECT DISTINCT image_id, CAST(CAST('0x' || substr(md5(image_id || '-1'), 1, 4) AS INT) % 6 AS INT) AS way FROM px8) SELECT image_id, way, CASE way WHEN 1 THEN c WHEN 2 THEN 7 - r WHEN 3 THEN 7 - c WHEN 4 THEN 7 - r ELSE r END AS r, CASE way WHEN 1 THEN 7 - r WHEN 2 THEN 7 - c WHEN 3 THEN r WHEN 5 THEN 7 - c ELSE c END AS c, round(v, 6) AS v FROM px8 JOIN w USING (image_id)"),
}
