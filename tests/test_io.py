"""Sources, sinks, models and streams, written and read again."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.operators import learning
from rastermill.plans import pipelines
from rastermill.sources import images, sinks, tables
from rastermill.streaming import scores


@pytest.fixture
def tree(tmp_path):
    """One image with two masks."""
    picture = np.arange(4 * 5 * 3).reshape(4, 5, 3)
    for kind, name, values in (("images", "one", picture), ("masks", "m1", np.eye(4, 5) * 255), ("masks", "m2", np.eye(4, 5)[::-1] * 7)):
        folder = tmp_path / "raw" / "one" / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.png").write_bytes(sinks.png_bytes(values))
    return tmp_path


def test_images_and_masks(spark, tree):
    raw = f"file://{tree}/raw"
    found = images.read_image_folders(spark, raw)
    assert [(r.image_id, r.height, r.width, r.n_channels) for r in found.collect()] == [("one", 4, 5, 3)]
    rows = {(r.r, r.c): (r.red, r.green, r.blue) for r in images.channels(images.pixels(found)).collect()}
    assert len(rows) == 20 and rows[1, 2] == (21, 22, 23)
    masks = images.read_mask_folders(spark, raw)
    assert images.mask_pixels(masks).groupBy("mask_id").count().orderBy("mask_id").collect() == [("m1", 4), ("m2", 4)]
    assert images.mask_pixels(masks, full_only=True).select("mask_id").distinct().collect() == [("m1",)]
    assert images.image_ids(spark, raw).collect() == [("one",)]
    assert images.read_images(spark, raw, size=(9, 9)).count() == 0
    assert images.list_files(spark, f"{raw}/one/masks").count() == 2 and images.file_frame(spark, ["a"]).collect() == [("a",)]


def test_pixels_and_png_round_trip(spark, tmp_path):
    px = spark.createDataFrame([(3, r, c, float((r + c) % 2)) for r in range(3) for c in range(4)], "image_id long, r int, c int, v double")
    frame = images.image_frame(px)
    assert sorted(images.pixel_frame(frame).collect()) == sorted(px.collect())
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "3.png").write_bytes(bytes(sinks.as_png(frame).first().png))
    back = images.pixels(images.read_images(spark, f"file://{tmp_path}/x"))
    assert sorted((r.r, r.c, r.v) for r in back.collect()) == sorted((r.r, r.c, 255 * r.v) for r in px.collect())


def test_tables(spark, tmp_path):
    at = f"file://{tmp_path}"
    sinks.write_submission(spark.createDataFrame([("a", "1 2"), ("b", "")], "ImageId string, EncodedPixels string"), f"{at}/sub")
    assert sorted((r.ImageId, r.DecodedPixels) for r in tables.read_labels(spark, f"{at}/sub").collect()) == [("a", [0, 1]), ("b", [])]
    sinks.write_centers(spark.createDataFrame([("i", 3, 4), ("i", 5, 6)], "image_id string, center_r int, center_c int"), f"{at}/centers")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "img.txt").write_text("# col row\n3 4\n5 6\n")
    assert tables.read_centers(spark, f"{at}/c").orderBy("center_r").collect() == [("img", 3.0, 4.0), ("img", 5.0, 6.0)]
    assert tables.read_centers(spark, f"{at}/centers").orderBy("center_r").collect() == [("i", 3.0, 4.0), ("i", 5.0, 6.0)]
    odd = [("007", 1, 2), ("a b:c+d%20", 3, 4), ("007", 0, 9)]
    sinks.write_centers(spark.createDataFrame(odd, "image_id string, center_r int, center_c int"), f"{at}/odd")
    assert sorted(map(tuple, tables.read_centers(spark, f"{at}/odd").collect())) == sorted((i, float(r), float(c)) for i, r, c in odd)
    assert all(p.read_text().startswith("# ") for p in (tmp_path / "odd").glob("*/*.txt"))
    (tmp_path / "points.txt").write_text("p.jpg,1,2,3,4\n\nq.jpg,5,6\n")
    assert {r.picture: [tuple(p) for p in r.pts] for r in tables.read_annotations(spark, f"{at}/points.txt").collect()} == {"p.jpg": [(1, 2), (3, 4)], "q.jpg": [(5, 6)]}
    (tmp_path / "x.cfg").write_text("[features]\nmethod: 'hog'\noptions: {'trim': [1, 99]}\n")
    assert tables.read_config(str(tmp_path / "x.cfg")) == {"features": {"method": "hog", "options": {"trim": [1, 99]}}}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/side.txt", "x")
    tables.unzip(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "in" / "side.txt").read_text() == "x"


def test_windows_splits_boxes_and_reports(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.createDataFrame([(1, 2, 2, [0.0, 1.0]), (2, 4, 4, [2.0])], "id long, height int, width int, image_matrix array<double>")
    sinks.write_windows(rows, f"{at}/w")
    assert tables.read_windows(spark, f"{at}/w", height=2).select("id").collect() == [(1,)] and tables.read_windows(spark, f"{at}/w").count() == 2
    sinks.write_window_table(rows, f"{at}/t")
    assert tables.read_csv(spark, f"{at}/t").columns == ["id", "height", "width"]
    sinks.write_splits(rows.withColumn("split", F.lit("train")), f"{at}/s")
    assert (tmp_path / "s" / "split=train").is_dir()
    sinks.write_boxes(rows.drop("image_matrix"), f"{at}/b")
    assert tables.read_csv(spark, f"{at}/b", "id long, height int, width int").count() == 2
    sinks.write_report(spark.createDataFrame([("a line",)], "line string"), f"{at}/r")
    assert spark.read.text(f"{at}/r").collect() == [("a line",)]


def test_models_are_kept(spark, sf_dir, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    from rastermill.operators.features import WindowFeatures

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("image_matrix"), (F.col("label") % 2).cast("double").alias("label"))
    model = Pipeline(stages=[WindowFeatures(method="gkhp", sigmas=[1.0, 2.0]), LogisticRegression(maxIter=3)]).fit(rows)
    learning.save(model, f"file://{tmp_path}/model")
    again = learning.load(spark, f"file://{tmp_path}/model")
    pick = lambda m: sorted((r.vec_id, r.prediction) for r in learning.score(m, rows).collect())
    assert pick(model) == pick(again)


def test_regions_exclude_one_another(spark):
    mask = spark.createDataFrame([(0, 1, 2, 2), (0, 1, 5, 6)], "image_id long, mask_id int, r int, c int")
    px = spark.createDataFrame([(0, r, c, 1.0) for r in range(10) for c in range(10)], "image_id long, r int, c int, v double")
    assert pipelines.region_windows(mask, px, 10, 10).count() == 12
    assert pipelines.region_windows(mask, px, 10, 10, padding=1).count() == 5 * 6
    assert pipelines.region_windows(mask, px, 10, 10, size=(4, 4)).count() == 16
    with pytest.raises(ValueError):
        pipelines.region_windows(mask, px, 10, 10, padding=1, square=True)


def test_streamed_scores_equal_those_of_the_whole(spark, tmp_path):
    schema = "image_id long, threshold double, tp long, fp long, fn long"
    data = [(k, t, k, 1, 2) for k in range(4) for t in (0.5, 0.9)]
    source = f"file://{tmp_path}/in"
    for k in range(4):  # one file for each image
        spark.createDataFrame([r for r in data if r[0] == k], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    scores.write_totals(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("threshold").collect()
    assert [(r.threshold, r.tp, r.fp, r.fn, r.precision) for r in got] == [(0.5, 6, 4, 8, 6 / 18), (0.9, 6, 4, 8, 6 / 18)]
