"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rastermill.operators import affine, boxes, codec, contours, contrast, evaluation, features, markers, masks, sampling, scaling, segmentation, shapes, splitting, statistics, tiling
from rastermill.operators import neighbourhood as nb

MASK = "image_id long, r int, c int"


def mask_of(spark, *pictures):
    """Pixels of '#' in pictures, and the pictures' sizes."""
    rows = [(k, r, c) for k, p in enumerate(pictures) for r, line in enumerate(p.split()) for c, x in enumerate(line) if x == "#"]
    sizes = [(k, len(p.split()), len(p.split()[0])) for k, p in enumerate(pictures)]
    return spark.createDataFrame(rows, MASK), spark.createDataFrame(sizes, "image_id long, height int, width int")


def drawn(df, height, width, image=0):
    on = {(r.r, r.c) for r in df.where(F.col("image_id") == image).collect()}
    return " ".join("".join("#" if (r, c) in on else "." for c in range(width)) for r in range(height))


def test_run_lengths(spark):
    mask = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("a", 0, 2), ("b", 2, 0), ("b", 0, 1)], "image_id string, r int, c int")
    assert {r.ImageId: r.EncodedPixels for r in codec.submission(mask, 3).collect()} == {"a": "1 2 7 1", "b": "3 2"}
    every = codec.encode_all(spark.createDataFrame([("a",), ("c",)], "image_id string"), mask.where("image_id = 'a'").select("image_id", codec.column_major(3).alias("p")), ["image_id"])
    assert {r.image_id: r.EncodedPixels for r in every.collect()} == {"a": "1 2 7 1", "c": ""}
    coded = spark.createDataFrame([("142 1 456 3",), ("",), (None,)], "x string")
    assert [r[0] for r in coded.select(codec.decoded("x")).collect()] == [[141, 455, 456, 457], [], []]


def test_boxes_of_a_fixed_size(spark):
    row = masks.fixed_boxes(spark.createDataFrame([(40, 250)], "center_r int, center_c int"), (64, 64), 256, 256).first()
    assert (row.row_min, row.row_max, row.col_min, row.col_max) == (9, 73, 219, 256)


def test_overlap_and_suppression(spark):
    rows = [(0, 0, 0, 0, 0.9), (0, 1, 0, 32, 0.8), (0, 2, 0, 0, 0.7), (1, 0, 5, 5, 0.1)]
    df = spark.createDataFrame(rows, "image_id long, ordinal int, anchor_r int, anchor_c int, score double").withColumns({"window_h": F.lit(64), "window_w": F.lit(64)})
    pairs = boxes.overlapping_pairs(df.withColumn("rank", F.col("ordinal")), 0.01).collect()
    assert {(r.a, r.b): round(r.overlap, 6) for r in pairs} == {(0, 1): round(1 / 3, 6), (0, 2): 1.0, (1, 2): round(1 / 3, 6)}
    assert sorted((r.image_id, r.score) for r in boxes.non_maximum_suppression(df, 0.5).collect()) == [(0, 0.8), (0, 0.9), (1, 0.1)]
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            boxes.non_maximum_suppression(df, bad)


def test_scores(spark):
    schema = "image_id long, mask_id int, r int, c int"
    own = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1), (0, 2, 5, 5)], schema)
    perfect = evaluation.with_precision(evaluation.image_scores(own, own)).collect()
    assert all((r.tp, r.fp, r.fn, r.precision) == (2, 0, 0, 1.0) for r in perfect) and len(perfect) == 10
    twice = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 0, 0)], schema)
    one = spark.createDataFrame([(0, 1, 0, 0)], schema)
    many = evaluation.with_precision(evaluation.image_scores(twice, one)).collect()
    assert all((r.tp, r.fp, r.fn, r.precision) == (2, 0, -1, 2.0) for r in many)
    none = evaluation.with_precision(evaluation.image_scores(own.where("image_id > 0"), one)).first()
    assert (none.tp, none.fp, none.fn, none.precision) == (0, 0, 1, 0.0)


def test_splits_drop_the_rest(spark):
    rows = sampling.split_by_ratio(spark.range(10).withColumnRenamed("id", "k"), "k", ["train", "test"], [0.7, 0.25]).collect()
    assert [sum(r.split == s for r in rows) for s in ("train", "test")] == [7, 2]
    with pytest.raises(ValueError):
        sampling.split_by_ratio(spark.range(3), "id", ["a"], [0.5, 0.5])


def test_window_starts(spark):
    images = spark.createDataFrame([(0, 256, 256)], "image_id long, height int, width int")
    starts = sorted({r.row_min for r in tiling.training_windows(images, (64, 64), 20).select("row_min").distinct().collect()})
    assert starts == list(range(0, 192, 9)) and len(starts) == 22


def test_negatives_may_not_exist(spark):
    images = spark.createDataFrame([(0, 8, 8), (1, 8, 8)], "image_id long, height int, width int")
    centers = spark.createDataFrame([(0, r, c) for r in range(8) for c in range(8)], MASK)
    rows = sampling.negatives(images, centers, (4, 4), 3, 0).collect()
    assert {r.image_id for r in rows} == {1} and len(rows) == 3


def test_components_holes_and_sizes(spark):
    mask, images = mask_of(spark, "##... ..#.. ....# ###.. #.#.. ###..")
    eight = segmentation.components(mask, 8).groupBy("segment").count().collect()
    four = segmentation.components(mask, 4).groupBy("segment").count().collect()
    assert sorted(r["count"] for r in eight) == [1, 3, 8] and sorted(r["count"] for r in four) == [1, 1, 2, 8]
    assert drawn(segmentation.fill_holes(mask, images), 6, 5) == "##... ..#.. ....# ###.. ###.. ###.."


def test_ultimate_erosion_keeps_what_would_vanish(spark):
    mask, images = mask_of(spark, "....... .#####. .#####. .#####. .......", "......... .###..... .#######. .###..... .........")
    assert drawn(markers.last_eroded(mask, images), 5, 7) == "....... ....... ..###.. ....... ......."
    assert drawn(markers.last_eroded(mask, images), 5, 9, 1) == "......... ......... ..##..... ......... ........."
    d = {(r.r, r.c): r.d for r in markers.city_block_distances(mask, images).where("image_id = 0").collect()}
    assert (d[1, 1], d[2, 3], d[2, 2]) == (1, 2, 2)
    full = mask_of(spark, "### ###")
    assert drawn(markers.ultimate_erosion(*full, 0), 2, 3) == "### ###"


def test_hulls_and_areas(spark):
    mask, _ = mask_of(spark, "####. #.... #.... ####.", "##### #...# #####")
    got = {r.image_id: (r.area, r.convex_area, r.filled_area) for r in shapes.shape_properties(mask, ["image_id"]).collect()}
    assert got == {0: (10, 16, 10), 1: (12, 15, 15)}


def test_contours_go_round_clockwise(spark):
    mask, _ = mask_of(spark, ".#. ### .#.")
    rows = shapes.contours(mask.withColumn("v", F.lit(1.0)), ["image_id"], 0.5).orderBy("contour", "i").collect()
    assert len(rows) == 13 and (rows[0].y, rows[0].x) == (rows[-1].y, rows[-1].x) == (-0.5, 1.0)
    assert [(r.y, r.x) for r in rows[1:4]] == [(0.0, 1.5), (0.5, 2.0), (1.0, 2.5)]
    assert shapes.outline_length(mask).first().points == 13


def test_lines(spark):
    row = spark.range(1).select(shapes.line(*map(F.lit, (0, 0, 2, 4))).alias("p"), shapes.line(*map(F.lit, (3, 3, 3, 3))).alias("q")).first()
    assert [tuple(x) for x in row.p] == [(0, 0), (1, 1), (1, 2), (2, 3), (2, 4)] and [tuple(x) for x in row.q] == [(3, 3)]


DUMBBELL = "................. .#####....######. .######.########. .#######.#######. .###############. .###############. .###############. .######.########. .#####...#######. .#####....######. ................."


def test_concave_points_lie_at_the_waist(spark):
    mask, _ = mask_of(spark, DUMBBELL)
    points = splitting.non_convex_points(mask.withColumn("segment", F.lit("s")), distance=2, reach=3, max_angle=-1.8).collect()
    assert sorted((p.y, p.x) for p in points) == [(2.5, 7.0), (7.0, 6.5)]
    for option in ("closest", "all"):
        rows = splitting.non_convex_points(mask.withColumn("segment", F.lit("s")), option).collect()
        assert rows and all(6 <= p.x <= 9 for p in rows)


def test_a_cut_parts_a_dumbbell(spark):
    mask, _ = mask_of(spark, DUMBBELL)
    segments = mask.withColumn("segment", F.lit("s"))
    for scoring, limit in (("distance", 8.0), ("circularity", 12.0)):
        cut = splitting.split_segments(segments, scoring=scoring, limit=limit, distance=2, reach=3, max_angle=-1.8)
        assert segmentation.components(cut.select("image_id", "r", "c"), 4).select("segment").distinct().count() == 2, scoring
    assert splitting.split_segments(segments).count() == mask.count()  # no line is short enough for the default limit
    with pytest.raises(ValueError):
        splitting.split_segments(segments, scoring="guess")


def test_edges_follow_a_step(spark):
    px = spark.createDataFrame([(0, r, c, float(c >= 6)) for r in range(12) for c in range(12)], "image_id long, r int, c int, v double")
    images = spark.createDataFrame([(0, 12, 12)], "image_id long, height int, width int")
    edges = {(r.r, r.c) for r in contrast.canny(px, images, 1.0).collect()}
    assert {c for _, c in edges} <= {5, 6} and {r for r, _ in edges} == set(range(1, 11))


def test_adaptive_equalisation_of_a_flat_image_is_flat(spark):
    px = spark.createDataFrame([(0, r, c, 3.0) for r in range(16) for c in range(16)], "image_id long, r int, c int, v double")
    images = spark.createDataFrame([(0, 16, 16)], "image_id long, height int, width int")
    values = {round(r.v, 9) for r in contrast.clahe(px, images, 2, 0.5, 16).collect()}
    assert len(values) == 1


def test_preprocessing_in_one_order(spark):
    px = spark.createDataFrame([(0, 0, c, float(c)) for c in range(5)], "image_id long, r int, c int, v double")
    images = spark.createDataFrame([(0, 1, 5)], "image_id long, height int, width int")
    got = [r.v for r in contrast.process_images(px, images, {"norm": "x", "trim": [0, 75]}).orderBy("c").collect()]
    assert got == pytest.approx([0, 1 / 3, 2 / 3, 1, 1])
    assert [r.v for r in contrast.process_images(px, images, {"trim": [1]}).orderBy("c").collect()] == [0, 1, 2, 3, 4]


def test_resizing(spark):
    px = spark.createDataFrame([(0, 0, c, float(c)) for c in range(4)], "image_id long, r int, c int, v double")
    images = spark.createDataFrame([(0, 1, 4)], "image_id long, height int, width int")
    assert [r.v for r in scaling.rescale_images(px, images, 0.5).orderBy("c").collect()] == [0.5, 2.5]
    assert [r.v for r in scaling.rescale_images(px, images).orderBy("c").collect()] == [0, 1, 2, 3]


def test_hog_blocks_have_length_one_or_less(spark):
    px = spark.createDataFrame([(0, r, c, float((r * c) % 7)) for r in range(24) for c in range(16)], "image_id long, r int, c int, v double")
    images = spark.createDataFrame([(0, 24, 16), (1, 8, 8)], "image_id long, height int, width int")
    rows = features.hog_descriptor(px, images).groupBy("image_id", "br", "bc").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n"), F.count("*").alias("k")).collect()
    assert len(rows) == 2 and all(r.n == pytest.approx(1, abs=1e-3) and r.k == 36 for r in rows)


def test_features_by_name(spark):
    windows = spark.createDataFrame([(7, r, c, float(r * 2 + c)) for r in range(2) for c in range(2)], "id long, wr int, wc int, v double")
    assert features.window_features(windows, ["id"], 2, 2).first().features.tolist() == [0, 1, 2, 3]
    assert len(features.window_features(windows, ["id"], 2, 2, "gkhp", {"sigmas": [1.0, 3.0]}).first().features) == 2
    with pytest.raises(ValueError):
        features.window_features(windows, ["id"], 2, 2, "magic")


def test_trimming_with_bounds_off(spark):
    px = spark.createDataFrame([(0, float(k)) for k in range(101)], "image_id long, v double")
    for left, right, low, high in ((1, 99, 1.0, 99.0), (0, 99, 0.0, 99.0), (1, None, 1.0, 100.0), (None, 0, 0.0, 100.0)):
        row = statistics.trim_percentiles(px, ["image_id"], left=left, right=right).agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        assert (row.a, row.b) == (low, high)


def test_distance_without_background_is_null(spark):
    assert {r.d2 for r in nb.squared_distances(*mask_of(spark, "## ##")).collect()} == {None}


def test_angles_of_a_straight_line(spark):
    line = spark.createDataFrame([("k", i, 0.0, float(i)) for i in range(5)], "key string, i int, y double, x double")
    assert [round(r.angle, 6) for r in contours.angles(line, "key", 1).orderBy("i").collect()] == [0, *[round(-math.pi / 2, 6)] * 3, 0]


def test_degenerate_boxes_become_the_image(spark):
    row = spark.range(1).select(*affine.clamp_box(*map(F.lit, (5, 5, 3, 9)), F.lit(60), F.lit(50))).first()
    assert tuple(row) == (0, 0, 50, 60)


def test_centred_images_are_standardised_and_moved_by_hash(spark):
    px = spark.createDataFrame([(k, r, c, float((k + 3 * r + c * c) % 11)) for k in (1, 2) for r in range(9) for c in range(9)], "image_id long, r int, c int, v double")
    images = spark.createDataFrame([(k, 9, 9) for k in (1, 2)], "image_id long, height int, width int")
    still, moved, again = (affine.centered_images(px, images, (8, 8), 1.0, seed).orderBy("image_id", "r", "c").collect() for seed in (None, 3, 3))
    assert len(still) == len(moved) == 128 and moved == again and moved != still
    assert sum(r.v for r in still) == pytest.approx(0, abs=1e-6)


def test_empty_tables(spark):
    mask, images = mask_of(spark, "..")
    mask = mask.limit(0)
    assert segmentation.components(mask).count() == 0 and markers.ultimate_erosion(mask, images).count() == 0
    assert shapes.convex_hull(mask, ["image_id"]).count() == 0 and codec.submission(mask, 1).count() == 0
    assert splitting.split_segments(mask.withColumn("segment", F.lit("s"))).count() == 0


def test_random_walks_and_merging(spark):
    from rastermill.operators import walks

    # two plates with a dark column between them, which has a gap at the bottom
    v = [[0.0 if c == 4 and r < 5 else 1.0 for c in range(9)] for r in range(6)]
    px = spark.createDataFrame([(1, r, c, v[r][c]) for r in range(6) for c in range(9)], "image_id long, r int, c int, v double")
    marks = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 8, "b")], "image_id long, r int, c int, segment string")
    got = {(r.r, r.c): r.segment for r in walks.random_walker(px, marks).collect()}
    assert len(got) == 54 and all(got[r, c] == ("a" if c < 4 else "b") for r in range(6) for c in range(9) if c != 4)
    # chances by solving the equations outright
    import numpy as np

    places, sd = sorted(got), np.std(v)
    at = {p: k for k, p in enumerate(places)}
    system = np.zeros((54, 54))
    for r, c in places:
        for q in ((r + 1, c), (r, c + 1)):
            if q in at:
                w = np.exp(-130 * (v[r][c] - v[q[0]][q[1]]) ** 2 / (10 * sd)) + 1e-10
                for x, y in ((at[r, c], at[q]), (at[q], at[r, c])):
                    system[x, x] += w
                    system[x, y] -= w
    right = np.zeros(54)
    for p, chance in (((0, 0), 1.0), ((0, 8), 0.0)):
        system[at[p]] = 0
        system[at[p], at[p]], right[at[p]] = 1, chance
    chance = np.linalg.solve(system, right)
    assert all((got[p] == "a") == (chance[at[p]] >= 0.5) for p in places if abs(chance[at[p]] - 0.5) > 1e-3)

    flat = spark.createDataFrame([(1, r, c, 0.0 if c < 5 else 1.0) for r in range(6) for c in range(9)], "image_id long, r int, c int, v double")
    parts = {(r.r, r.c): r.segment for r in walks.graph_segments(flat, scale=10, sigma=0, min_size=3).collect()}
    assert parts == {(r, c): "0-0" if c < 5 else "0-5" for r in range(6) for c in range(9)}
    assert {r.segment for r in walks.graph_segments(flat, scale=10, sigma=0, min_size=30).collect()} == {"0-0"}
    assert walks.random_walker(px, marks.limit(0)).count() == 0


def test_large_images_give_the_same_rows(spark, sf_dir, monkeypatch):
    """Images above the bounds go through graphs and rounds over many tasks."""
    from rastermill.plans import views

    px = views.px64(spark, sf_dir)
    mask = views.above(px, 0.6).withColumn("level", F.floor(F.col("v") * 2))
    found = {}
    for large in (False, True):
        if large:
            monkeypatch.setattr(segmentation, "MOST_PIXELS", 700)  # some images are larger, some aren't
            monkeypatch.setattr(boxes, "MOST_BOXES", 0)
        rows = [segmentation.components(mask, 8), segmentation.components(mask, 4), segmentation.components(mask, 8, level="level"), boxes.non_maximum_suppression(views.boxes(spark, sf_dir), 0.2).select("image_id", "ordinal")]
        found[large] = [sorted(map(tuple, r.collect())) for r in rows]
    assert found[False] == found[True]
