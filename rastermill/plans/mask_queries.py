"""Queries over masks: run lengths, set operations, boxes, segments, matching and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import read_table
from ..operators import boxes as bx
from ..operators import codec, evaluation, masks, segmentation
from ..operators import neighbourhood as nb
from . import views as v


def _foreground(spark, sf_dir):
    return v.trimmed_foreground(v.px64(spark, sf_dir))


def rle_submission(spark, sf_dir):
    return codec.submission(_foreground(spark, sf_dir), 64)


def rle_decode_roundtrip(spark, sf_dir):
    coded = codec.submission(_foreground(spark, sf_dir), 64)
    return coded.select("ImageId", F.explode(codec.decoded("EncodedPixels")).alias("place")).groupBy("ImageId").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.sum("place").alias("total"))


def place_to_row_col(spark, sf_dir):
    rows = v.px64(spark, sf_dir).select("image_id", (codec.column_major(64) - 1).alias("p"))
    (r, c), (_, up) = codec.row_col("p", 64), codec.row_col("p", 64, compat=True)
    return rows.select("image_id", "p", r.alias("r"), c.alias("c"), up.alias("c_compat"))


def _two(spark, sf_dir):
    px = v.px64(spark, sf_dir)
    return v.above(px, 0.5), v.above(px, 0.6)


def _families(spark, sf_dir):
    exp, pred = _two(spark, sf_dir)
    shifted = pred.withColumn("c", F.least(F.col("c") + 1, F.lit(63))).select("image_id", "r", "c").distinct()
    return v.tiles(shifted), v.tiles(exp)


def mask_union(spark, sf_dir):
    return masks.union(*_two(spark, sf_dir))


def mask_intersection(spark, sf_dir):
    return masks.intersection(*_two(spark, sf_dir))


def mask_difference(spark, sf_dir):
    return masks.difference(*_two(spark, sf_dir))


def _tiled(spark, sf_dir):
    return v.tiles(v.above(v.px64(spark, sf_dir), 0.9))


_KEYS = ["image_id", "mask_id"]


def mask_bbox(spark, sf_dir):
    return masks.with_centers(masks.bounding_boxes(_tiled(spark, sf_dir), _KEYS))


def mask_bbox_compat(spark, sf_dir):
    return masks.bounding_boxes(_tiled(spark, sf_dir), _KEYS, compat=True)


def roi_fixed_box(spark, sf_dir):
    return masks.fixed_boxes(masks.with_centers(masks.bounding_boxes(_tiled(spark, sf_dir), _KEYS)), (16, 16), 64, 64)


def roi_padded_box(spark, sf_dir):
    return masks.padded_boxes(masks.bounding_boxes(_tiled(spark, sf_dir), _KEYS), 3, 64, 64)


def roi_square_box(spark, sf_dir):
    return masks.square_boxes(masks.bounding_boxes(_tiled(spark, sf_dir), _KEYS), 64, 64)


def roi_crop_sums(spark, sf_dir):
    px = v.px64(spark, sf_dir)
    boxes = masks.bounding_boxes(v.tiles(v.above(px, 0.9)), _KEYS)
    return masks.crop(px, boxes).groupBy(*_KEYS).agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"), F.max("wr").alias("last_r"), F.max("wc").alias("last_c"))


def segment_size_filter(spark, sf_dir):
    return masks.size_filter(_tiled(spark, sf_dir), _KEYS, 20, 30)


def region_properties(spark, sf_dir):
    rows = segmentation.region_properties(_tiled(spark, sf_dir), _KEYS)
    return rows.select(*_KEYS, "area", *[F.round(c, 6).alias(c) for c in ("centroid_r", "centroid_c", "equivalent_diameter")])


def closest_to_centroid(spark, sf_dir):
    tiled = _tiled(spark, sf_dir)
    centers = tiled.groupBy(*_KEYS).agg(F.floor(F.avg("r")).cast("int").alias("center_r"), F.floor(F.avg("c")).cast("int").alias("center_c"))
    return segmentation.closest_pixels(tiled, centers, _KEYS).select(*_KEYS, "r", "c", F.col("d2").cast("int").alias("d2"))


def iou_best_match(spark, sf_dir):
    return evaluation.best_matches(*_families(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


def _scores(spark, sf_dir):
    return evaluation.image_scores(*_families(spark, sf_dir))


def _rounded(rows):
    return rows.withColumns({"precision": F.round("precision", 9), "threshold": F.round("threshold", 2)})


def score_thresholds(spark, sf_dir):
    return _rounded(evaluation.with_precision(_scores(spark, sf_dir)))


def score_cumulative(spark, sf_dir):
    return _rounded(evaluation.cumulative_scores(_scores(spark, sf_dir)))


def score_running(spark, sf_dir):
    return _rounded(evaluation.running_scores(_scores(spark, sf_dir)))


def score_mean(spark, sf_dir):
    return evaluation.mean_score(_scores(spark, sf_dir), ["image_id"]).withColumn("score", F.round("score", 9))


def _sparse(spark, sf_dir, share=0.7):
    px = v.px64(spark, sf_dir)
    return v.above(px, share), v.dims(px)


def components(spark, sf_dir):
    return segmentation.components(_sparse(spark, sf_dir)[0])


def component_sizes_4(spark, sf_dir):
    return segmentation.components(_sparse(spark, sf_dir)[0], 4).groupBy("image_id", "segment").agg(F.count("*").alias("size"))


def fill_holes(spark, sf_dir):
    return segmentation.fill_holes(*_sparse(spark, sf_dir, 0.5))


def adaptive_markers(spark, sf_dir):
    mask, images = _sparse(spark, sf_dir, 0.3)
    return segmentation.adaptive_markers(mask, images)


def watershed_segments(spark, sf_dir):
    mask, images = _sparse(spark, sf_dir, 0.3)
    return segmentation.segment(mask, images).groupBy("image_id", "segment").agg(F.count("*").alias("size"))


def random_walker_segments(spark, sf_dir):
    mask, images = _sparse(spark, sf_dir, 0.3)
    return segmentation.segment(mask, images, "random_walker").groupBy("image_id", "segment").agg(F.count("*").alias("size"))


def graph_segments(spark, sf_dir):
    mask, images = _sparse(spark, sf_dir, 0.3)
    return segmentation.segment(mask, images, "graph").groupBy("image_id", "segment").agg(F.count("*").alias("size"))


def box_iou_pairs(spark, sf_dir):
    ranked = v.boxes(spark, sf_dir).withColumn("rank", F.col("ordinal"))
    return bx.overlapping_pairs(ranked, 0.3).withColumn("overlap", F.round("overlap", 9))


def nms_greedy(spark, sf_dir):
    return bx.non_maximum_suppression(v.boxes(spark, sf_dir), 0.2).select("image_id", "ordinal", "anchor_r", "anchor_c", "score")


def sliding_window_masks(spark, sf_dir):
    from ..operators import tiling

    px = v.px64(spark, sf_dir)
    kept = bx.non_maximum_suppression(v.boxes(spark, sf_dir).where("score > 0"), 0.2)
    mask = tiling.boxes_to_mask(kept, v.dims(px), (3, 3))
    return codec.submission(mask, 64)


def incorrect_predictions(spark, sf_dir):
    return evaluation.predictions(_classes(spark, sf_dir), False)


def _classes(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("expected"), (1 - F.col("toxic")).cast("int").alias("predicted"))


def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(_classes(spark, sf_dir))


def classification_report(spark, sf_dir):
    rows = evaluation.classification_report(_classes(spark, sf_dir))
    return rows.select(F.col("class"), "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _rle_sql(body: str, source: str) -> str:
    return f"""{body}, pos AS (SELECT image_id, c * 64 + r + 1 AS p FROM {source}),
runs AS (SELECT image_id, min(p) AS st, count(*) AS n FROM (SELECT image_id, p, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS g FROM pos) GROUP BY image_id, g)"""


_CLIPPED = f"""WITH {v.PX64}, cut AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px64 GROUP BY 1),
clipped AS (SELECT p.image_id, p.r, p.c, least(greatest(p.v, lo), hi) AS v FROM px64 p JOIN cut USING (image_id)), {v.above_sql('fg', 0.5, 'clipped')}"""
_PAIR = f"WITH {v.PX64}, {v.above_sql('a', 0.5)}, {v.above_sql('b', 0.6)}"
_TILED = f"WITH {v.PX64}, {v.above_sql('hot', 0.9)}, {v.tiles_sql('tiled', 'hot')}"
_BOX = f"{_TILED}, box AS (SELECT image_id, mask_id, min(r) AS row_min, max(r) AS row_max, min(c) AS col_min, max(c) AS col_max FROM tiled GROUP BY 1, 2)"
_CENTER = f"{_BOX}, mid AS (SELECT *, (row_max + row_min) // 2 AS center_r, (col_max + col_min) // 2 AS center_c FROM box)"
_MATCH = f"""{_PAIR}, moved AS (SELECT DISTINCT image_id, r, least(c + 1, 63) AS c FROM b), {v.tiles_sql('pred', 'moved')}, {v.tiles_sql('exp', 'a')},
inter AS (SELECT p.image_id, p.mask_id AS pred_id, e.mask_id AS exp_id, count(*) AS k FROM pred p JOIN exp e USING (image_id, r, c) GROUP BY 1, 2, 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY k DESC, exp_id) AS rn FROM inter) WHERE rn = 1),
ps AS (SELECT image_id, mask_id AS pred_id, count(*) AS n_p FROM pred GROUP BY 1, 2), es AS (SELECT image_id, mask_id AS exp_id, count(*) AS n_e FROM exp GROUP BY 1, 2),
match AS (SELECT ps.image_id, ps.pred_id, best.exp_id, coalesce(k / (n_p + n_e - k), 0.0) AS iou FROM ps LEFT JOIN best USING (image_id, pred_id) LEFT JOIN es ON es.image_id = best.image_id AND es.exp_id = best.exp_id)"""
_SCORE = f"""{_MATCH}, th AS (SELECT unnest([{', '.join(f'CAST({t!r} AS DOUBLE)' for t in evaluation.THRESHOLDS)}]) AS threshold),
ne AS (SELECT image_id, count(*) AS n_exp FROM es GROUP BY 1), hit AS (SELECT image_id, threshold, count(*) AS n_pred, CAST(sum(CASE WHEN iou > threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM match, th GROUP BY 1, 2),
score AS (SELECT image_id, threshold, tp, n_pred - tp AS fp, n_exp - tp AS fn FROM ne JOIN hit USING (image_id))"""
_PREC = "round(tp / nullif(tp + fp + fn, 0), 9) AS precision"
_CLASSES = "WITH k AS (SELECT doc_id, CAST(quality AS INT) AS expected, CAST(1 - toxic AS INT) AS predicted FROM labels)"
_CLIP = "least(greatest({}, 0), 64)"

_SPARSE = f"WITH RECURSIVE {v.PX64}, {v.above_sql('m', 0.7)}"
#: label: each pixel of m with the least of its component; pixels are known by their places in row order.
_LABELS = """p AS (SELECT image_id, r, c, r * 64 + c AS id FROM m), o AS (SELECT a AS dr, b AS dc FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE abs(a) + abs(b) BETWEEN 1 AND {reach}),
near AS (SELECT p.image_id, p.id, q.id AS other FROM (SELECT image_id, id, r + dr AS r, c + dc AS c FROM p, o) p JOIN p q USING (image_id, r, c)),
lower AS (SELECT image_id, id, id AS least_id FROM p UNION SELECT near.image_id, other, least_id FROM lower JOIN near ON near.image_id = lower.image_id AND near.id = lower.id WHERE least_id < other),
label AS (SELECT image_id, id, min(least_id) AS least_id FROM lower GROUP BY 1, 2)"""
_SEGMENT = "(least_id // 64) || '-' || (least_id % 64) AS segment"
_HOLES = f"""WITH RECURSIVE {v.PX64}, {v.above_sql('m', 0.5)}, ground AS (SELECT image_id, r, c FROM px64 EXCEPT SELECT image_id, r, c FROM m), o AS (SELECT unnest([-1, 1, 0, 0]) AS dr, unnest([0, 0, -1, 1]) AS dc),
outside AS (SELECT image_id, r, c FROM ground WHERE r IN (0, 63) OR c IN (0, 63) UNION SELECT g.image_id, g.r, g.c FROM (SELECT image_id, r + dr AS r, c + dc AS c FROM outside, o) x JOIN ground g USING (image_id, r, c))"""
#: kept: boxes that greedy suppression keeps, one after another by score.
_GREEDY = """ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ordinal) AS rank FROM boxes WHERE {where}),
greedy AS (SELECT image_id, 0::BIGINT AS rank, []::STRUCT(r INT, c INT, rank BIGINT)[] AS held FROM (SELECT DISTINCT image_id FROM ranked)
  UNION ALL SELECT b.image_id, b.rank, CASE WHEN len(list_filter(held, lambda h: greatest(0, 16 - abs(h.r - b.anchor_r)) * greatest(0, 16 - abs(h.c - b.anchor_c)) >= 0.2::DOUBLE * (512 - greatest(0, 16 - abs(h.r - b.anchor_r)) * greatest(0, 16 - abs(h.c - b.anchor_c))))) = 0
    THEN list_append(held, {{'r': b.anchor_r, 'c': b.anchor_c, 'rank': b.rank}}) ELSE held END FROM greedy g JOIN ranked b ON b.image_id = g.image_id AND b.rank = g.rank + 1),
last AS (SELECT image_id, max(rank) AS rank FROM greedy GROUP BY 1),
kept AS (SELECT r.* FROM ranked r JOIN (SELECT image_id, unnest(held).rank AS rank FROM greedy JOIN last USING (image_id, rank)) USING (image_id, rank))"""

QUERIES = {
    "rle_submission": (rle_submission, f"{_rle_sql(_CLIPPED, 'fg')} SELECT image_id AS \"ImageId\", string_agg(st || ' ' || n, ' ' ORDER BY st) AS \"EncodedPixels\" FROM runs GROUP BY 1"),
    "rle_decode_roundtrip": (rle_decode_roundtrip, f"{_rle_sql(_CLIPPED, 'fg')} SELECT image_id AS \"ImageId\", count(*) AS n, min(p - 1) AS first, max(p - 1) AS last, CAST(sum(p - 1) AS BIGINT) AS total FROM pos GROUP BY 1"),
    "place_to_row_col": (place_to_row_col, f"WITH {v.PX64} SELECT image_id, CAST(c * 64 + r AS BIGINT) AS p, r, c, CAST(ceil((c * 64 + r) / 64.0) AS INT) AS c_compat FROM px64"),
    "mask_union": (mask_union, f"{_PAIR} SELECT image_id, r, c FROM a UNION SELECT image_id, r, c FROM b"),
    "mask_intersection": (mask_intersection, f"{_PAIR} SELECT image_id, r, c FROM a INTERSECT SELECT image_id, r, c FROM b"),
    "mask_difference": (mask_difference, f"{_PAIR} SELECT image_id, r, c FROM a EXCEPT SELECT image_id, r, c FROM b"),
    "mask_bbox": (mask_bbox, f"{_CENTER} SELECT * FROM mid"),
    "mask_bbox_compat": (mask_bbox_compat, f"{_TILED} SELECT image_id, mask_id, min(r) AS row_min, max(r) AS row_max, min(CASE WHEN r > 0 THEN c + 1 ELSE c END) AS col_min, max(CASE WHEN r > 0 THEN c + 1 ELSE c END) AS col_max FROM tiled GROUP BY 1, 2"),
    "roi_fixed_box": (roi_fixed_box, f"{_CENTER} SELECT image_id, mask_id, {_CLIP.format('center_r - 7')} AS row_min, {_CLIP.format('center_r + 9')} AS row_max, {_CLIP.format('center_c - 7')} AS col_min, {_CLIP.format('center_c + 9')} AS col_max, center_r, center_c FROM mid"),
    "roi_padded_box": (roi_padded_box, f"{_BOX} SELECT image_id, mask_id, greatest(row_min - 3, 0) AS row_min, least(row_max + 3, 64) AS row_max, greatest(col_min - 3, 0) AS col_min, least(col_max + 3, 64) AS col_max FROM box"),
    "roi_square_box": (roi_square_box, f"{_CENTER}, s AS (SELECT *, greatest(row_max - row_min, col_max - col_min) AS side FROM mid) SELECT image_id, mask_id, center_r, center_c, side, {_CLIP.format('center_r - (side // 2 - 1)')} AS row_min, {_CLIP.format('center_r + side - (side // 2 - 1)')} AS row_max, {_CLIP.format('center_c - (side // 2 - 1)')} AS col_min, {_CLIP.format('center_c + side - (side // 2 - 1)')} AS col_max FROM s"),
    "roi_crop_sums": (roi_crop_sums, f"{_BOX} SELECT b.image_id, b.mask_id, count(*) AS n, round(sum(v), 6) AS total, max(p.r - row_min) AS last_r, max(p.c - col_min) AS last_c FROM box b JOIN px64 p ON p.image_id = b.image_id AND p.r >= row_min AND p.r < row_max AND p.c >= col_min AND p.c < col_max GROUP BY 1, 2"),
    "segment_size_filter": (segment_size_filter, f"{_TILED} SELECT image_id, mask_id, count(*) AS size FROM tiled GROUP BY 1, 2 HAVING count(*) > 20 AND count(*) < 30"),
    "region_properties": (region_properties, f"{_TILED} SELECT image_id, mask_id, count(*) AS area, round(avg(r), 6) AS centroid_r, round(avg(c), 6) AS centroid_c, round(sqrt(4 * count(*) / pi()), 6) AS equivalent_diameter FROM tiled GROUP BY 1, 2"),
    "closest_to_centroid": (closest_to_centroid, f"{_TILED}, m AS (SELECT image_id, mask_id, CAST(floor(avg(r)) AS INT) AS cr, CAST(floor(avg(c)) AS INT) AS cc FROM tiled GROUP BY 1, 2) SELECT image_id, mask_id, r, c, d2 FROM (SELECT t.*, (r - cr) * (r - cr) + (c - cc) * (c - cc) AS d2, row_number() OVER (PARTITION BY t.image_id, t.mask_id ORDER BY (r - cr) * (r - cr) + (c - cc) * (c - cc), r, c) AS rn FROM tiled t JOIN m USING (image_id, mask_id)) WHERE rn = 1"),
    "iou_best_match": (iou_best_match, f"{_MATCH} SELECT image_id, pred_id, exp_id, round(iou, 9) AS iou FROM match"),
    "score_thresholds": (score_thresholds, f"{_SCORE} SELECT image_id, round(threshold, 2) AS threshold, tp, fp, fn, {_PREC} FROM score"),
    "score_cumulative": (score_cumulative, f"{_SCORE}, t AS (SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM score GROUP BY 1) SELECT round(threshold, 2) AS threshold, tp, fp, fn, {_PREC} FROM t"),
    "score_running": (score_running, f"{_SCORE}, t AS (SELECT image_id, threshold, CAST(sum(tp) OVER w AS BIGINT) AS tp, CAST(sum(fp) OVER w AS BIGINT) AS fp, CAST(sum(fn) OVER w AS BIGINT) AS fn FROM score WINDOW w AS (PARTITION BY threshold ORDER BY image_id)) SELECT image_id, round(threshold, 2) AS threshold, tp, fp, fn, {_PREC} FROM t"),
    "score_mean": (score_mean, f"{_SCORE} SELECT image_id, round(avg(tp / nullif(tp + fp + fn, 0)), 9) AS score FROM score GROUP BY 1"),
    "box_iou_pairs": (box_iou_pairs, f"""WITH {v.PX64}, {v.BOXES}, o AS (SELECT a.image_id, a.ordinal AS a, b.ordinal AS b, greatest(0, 16 - abs(a.anchor_r - b.anchor_r)) * greatest(0, 16 - abs(a.anchor_c - b.anchor_c)) AS k
  FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.ordinal < b.ordinal AND abs(a.anchor_r - b.anchor_r) < 16 AND abs(a.anchor_c - b.anchor_c) < 16) SELECT image_id, a, b, round(k / (512 - k), 9) AS overlap FROM o WHERE k / (512 - k) >= 0.3"""),
    "confusion_matrix": (confusion_matrix, f"{_CLASSES} SELECT expected, predicted, count(*) AS n FROM k GROUP BY 1, 2"),
    "classification_report": (classification_report, f"""{_CLASSES}, c AS (SELECT DISTINCT expected AS class FROM k UNION SELECT DISTINCT predicted FROM k),
s AS (SELECT class, (SELECT count(*) FROM k WHERE expected = class) AS support, (SELECT count(*) FROM k WHERE predicted = class) AS called, (SELECT count(*) FROM k WHERE predicted = class AND expected = class) AS tp FROM c),
m AS (SELECT class, support, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM s)
SELECT class, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM m"""),
    "incorrect_predictions": (incorrect_predictions, f"{_CLASSES} SELECT doc_id, expected, predicted FROM k WHERE expected IS DISTINCT FROM predicted"),
    "components": (components, f"{_SPARSE}, {_LABELS.format(reach=2)} SELECT image_id, CAST(id // 64 AS INT) AS r, CAST(id % 64 AS INT) AS c, {_SEGMENT} FROM label"),
    "component_sizes_4": (component_sizes_4, f"{_SPARSE}, {_LABELS.format(reach=1)} SELECT image_id, {_SEGMENT}, count(*) AS size FROM label GROUP BY image_id, least_id"),
    "fill_holes": (fill_holes, f"{_HOLES} SELECT image_id, r, c FROM px64 EXCEPT SELECT image_id, r, c FROM outside"),
    "adaptive_markers": (adaptive_markers, None),
    "watershed_segments": (watershed_segments, None),
    "random_walker_segments": (random_walker_segments, None),
    "graph_segments": (graph_segments, None),
    "nms_greedy": (nms_greedy, f"WITH RECURSIVE {v.PX64}, {v.BOXES}, {_GREEDY.format(where='true')} SELECT image_id, ordinal, anchor_r, anchor_c, score FROM kept"),
    "sliding_window_masks": (
        sliding_window_masks,
        _rle_sql(f"""WITH RECURSIVE {v.PX64}, {v.BOXES}, {_GREEDY.format(where='score > 0')}, d AS (SELECT unnest(range(0, 3)) AS d),
marked AS (SELECT DISTINCT image_id, anchor_r + 7 + a.d AS r, anchor_c + 7 + b.d AS c FROM kept, d a, d b WHERE anchor_r + 7 + a.d < 63 AND anchor_c + 7 + b.d < 63)""", "marked")
        + " SELECT image_id AS \"ImageId\", string_agg(st || ' ' || n, ' ' ORDER BY st) AS \"EncodedPixels\" FROM runs GROUP BY 1",
    ),
}


def _morphology():
    """Binary and grey morphology of disk(1) on the upper half of px64's values."""
    base = f"WITH {v.PX64}, {v.above_sql('m', 0.4)}, o AS (SELECT a AS dr, b AS dc FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE a * a + b * b <= 1)"
    dil = lambda n, s: f"{n} AS (SELECT DISTINCT image_id, r + dr AS r, c + dc AS c FROM {s}, o WHERE r + dr BETWEEN 0 AND 63 AND c + dc BETWEEN 0 AND 63)"
    ero = lambda n, s: f"{n} AS (SELECT image_id, r, c FROM (SELECT image_id, r + dr AS r, c + dc AS c FROM {s}, o) WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63 GROUP BY 1, 2, 3 HAVING count(*) = 5 - (r = 0)::INT - (r = 63)::INT - (c = 0)::INT - (c = 63)::INT)"
    grey = lambda n, s, f: f"{n} AS (SELECT image_id, r + dr AS r, c + dc AS c, {f}(v) AS v FROM {s}, o WHERE r + dr BETWEEN 0 AND 63 AND c + dc BETWEEN 0 AND 63 GROUP BY 1, 2, 3)"

    def over(f):
        return lambda spark, sf_dir: f(*_sparse(spark, sf_dir, 0.4)).select("image_id", "r", "c")

    def tophat(spark, sf_dir):
        px = v.px64(spark, sf_dir)
        return nb.white_tophat(px, v.dims(px)).withColumn("v", F.round("v", 6))

    def peaks(spark, sf_dir):
        px = v.px64(spark, sf_dir)
        return nb.local_maxima(px, v.dims(px), 2).withColumn("v", F.round("v", 6))

    def distances(spark, sf_dir):
        px = v.px8(spark, sf_dir)
        return nb.squared_distances(v.above(px, 0.2), v.dims(px))

    return {
        "dilate_disk1": (over(nb.dilate), f"{base}, {dil('d', 'm')} SELECT * FROM d"),
        "erode_disk1": (over(nb.erode), f"{base}, {ero('e', 'm')} SELECT * FROM e"),
        "open_disk1": (over(nb.opening), f"{base}, {ero('e', 'm')}, {dil('d', 'e')} SELECT * FROM d"),
        "close_disk1": (over(nb.closing), f"{base}, {dil('d', 'm')}, {ero('e', 'd')} SELECT * FROM e"),
        "white_tophat": (tophat, f"{base}, {grey('e', 'px64', 'min')}, {grey('d', 'e', 'max')} SELECT image_id, r, c, round(p.v - d.v, 6) AS v FROM px64 p JOIN d USING (image_id, r, c)"),
        "local_maxima": (peaks, f"WITH {v.PX64}, top AS (SELECT p.image_id, p.r, p.c, p.v, max(q.v) AS t FROM px64 p JOIN px64 q ON q.image_id = p.image_id AND q.r BETWEEN p.r - 2 AND p.r + 2 AND q.c BETWEEN p.c - 2 AND p.c + 2 GROUP BY 1, 2, 3, 4), least_v AS (SELECT image_id, min(v) AS lo FROM px64 GROUP BY 1) SELECT image_id, r, c, round(v, 6) AS v FROM top JOIN least_v USING (image_id) WHERE v = t AND v > lo"),
        "edt_small": (distances, f"WITH {v.PX8}, {v.above_sql('m', 0.2, 'px8')}, ground AS (SELECT image_id, r, c FROM px8 EXCEPT SELECT image_id, r, c FROM m) SELECT m.image_id, m.r, m.c, CAST(min((m.r - g.r) * (m.r - g.r) + (m.c - g.c) * (m.c - g.c)) AS BIGINT) AS d2 FROM m LEFT JOIN ground g ON g.image_id = m.image_id GROUP BY 1, 2, 3"),
    }


QUERIES |= _morphology()
