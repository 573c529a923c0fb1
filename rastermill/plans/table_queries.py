"""Queries over values, strings, samples, points and classifiers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from ..operators import affine, contours, kernels, learning, network, sampling, statistics
from . import views as v


def _round(rows, *names, digits=6):
    return rows.withColumns({n: F.round(n, digits) for n in names})


def trim_percentile_pixels(spark, sf_dir):
    return _round(statistics.trim_percentiles(v.px64(spark, sf_dir), ["image_id"]), "v")


def trim_percentile_lineitem(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("v"))
    return statistics.trim_percentiles(rows, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.min("v"), 4).alias("lo"), F.round(F.max("v"), 4).alias("hi"), F.round(F.sum("v"), 2).alias("total"))


def rescale_minmax(spark, sf_dir):
    return _round(statistics.rescale(v.px64(spark, sf_dir), ["image_id"]), "v")


def equalize_hist(spark, sf_dir):
    return _round(statistics.equalize(v.px64(spark, sf_dir), ["image_id"], bins=64), "v")


def standardize(spark, sf_dir):
    return _round(statistics.standardize(v.px64(spark, sf_dir), ["image_id"]), "v")


def standardize_orders(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    return _round(statistics.standardize(rows, ["o_orderpriority"]), "v")


def background_difference(spark, sf_dir):
    px = v.px64(spark, sf_dir)
    return _round(statistics.background_difference(px, v.above(px, 0.7)), "v")


def gray_from_channels(spark, sf_dir):
    rows = v.px8(spark, sf_dir).select(F.expr("image_id div 3").alias("image_id"), (F.col("image_id") % 3).alias("ch"), "r", "c", "v")
    pick = lambda k: F.max(F.when(F.col("ch") == k, F.col("v")))
    wide = rows.groupBy("image_id", "r", "c").agg(pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("d"))
    return wide.select("image_id", "r", "c", F.round(statistics.gray(F.col("a"), F.col("b"), F.col("d")), 8).alias("v"))


def price_histogram(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", "l_quantity")
    return _round(statistics.weighted_histogram(rows.withColumn("d", F.round(F.col("l_discount") * 100, 0)), ["l_returnflag"], "d", "l_quantity", [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]), "total", digits=2)


def value_counts_rank_2_16(spark, sf_dir):
    return statistics.value_counts(read_table(spark, sf_dir, "documents"), "source", 2, 16)


def describe_string(spark, sf_dir):
    return statistics.describe_string(read_table(spark, sf_dir, "part"), "p_type")


def n_unique(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"))


def split_by_ratio(spark, sf_dir):
    return sampling.split_by_ratio(read_table(spark, sf_dir, "documents"), "doc_id", ["train", "test"], [0.7, 0.25])


def split_stratified(spark, sf_dir):
    return sampling.stratified_subset(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 0.25, ["lang"])


def oversample_16(spark, sf_dir):
    return sampling.oversample(read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), 16)


def mini_batches(spark, sf_dir):
    return sampling.mini_batches(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 32)


def golden_else_model(spark, sf_dir):
    golden = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("x"))
    model = read_table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("x"))
    return sampling.first_wins(golden, model, "doc_id")


def contour_angle(spark, sf_dir):
    return _round(contours.angles(v.points(spark, sf_dir), "user_id", 2), "angle", "pointing", "y")


def contour_extrema(spark, sf_dir):
    rows = contours.sharp_turns(contours.angles(v.points(spark, sf_dir), "user_id", 2), "user_id", 2, -0.01)
    return _round(rows, "angle", "pointing", "y")


def bounding_rectangle(spark, sf_dir):
    return affine.bounding_rectangles(v.points(spark, sf_dir), "user_id")


def affine_coords(spark, sf_dir):
    m = affine.moving(5.0, 2.0, (0.9, 0.95), (3.0, -4.0))
    y, x = affine.apply(m, F.col("y"), F.col("x"))
    return v.points(spark, sf_dir).select("user_id", "i", x.alias("x"), y.alias("y"))


def center_transform(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 20).alias("h"), F.expr("p_partkey % 97 + 30").alias("w"))
    m = affine.grid_source(F.col("h"), F.col("w"))
    return rows.select("p_partkey", *[F.round(m[i][j], 6).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1, 2)])


def clamp_bbox(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).cast("int").alias(n) for n, e in (("x0", "l_partkey % 80 - 20"), ("y0", "l_suppkey % 70 - 20"), ("x1", "l_partkey % 90"), ("y1", "l_orderkey % 85"))])
    box = affine.clamp_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(60), F.lit(50))
    return rows.select("l_orderkey", "l_linenumber", *[b.alias(n) for b, n in zip(box, ("u0", "v0", "u1", "v1"), strict=True)])


def bilinear_center(spark, sf_dir):
    px = v.px8(spark, sf_dir)
    return _round(affine.transform_images(px, v.dims(px), (6, 6), 1.0), "v")


def _windows(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("image_matrix"), (F.col("label") % 2).cast("string").alias("is_positive"))
    return learning.pixel_features(rows).withColumn("label", learning.binary_target("is_positive"))


def mlp_train_score(spark, sf_dir):
    rows = _windows(spark, sf_dir)
    model = learning.train(learning.mlp(64, (20, 20), max_iter=60), rows)
    return learning.score(model, rows).select("vec_id", "label", "prediction", F.round("score", 4).alias("score"))


def svm_rff_train_score(spark, sf_dir):
    rows = learning.with_cosines(_windows(spark, sf_dir), 64)
    model = learning.train(learning.rbf_svm(c=100.0, max_iter=50), rows)
    return learning.score(model, rows).select("vec_id", "label", "prediction", F.round("score", 4).alias("score"))


def _quadrants(spark, sf_dir):
    """Quadrant means of each 8 x 8 image, of about unit variance; label: whether its upper and its left half are both brighter or both darker than 0; upper: whether its upper half is brighter."""
    px = v.px8(spark, sf_dir)
    mean = [F.avg(F.when(((F.col("r") < 4) if up else (F.col("r") >= 4)) & ((F.col("c") < 4) if left else (F.col("c") >= 4)), F.col("v"))) for up in (True, False) for left in (True, False)]
    rows = px.groupBy(F.col("image_id").alias("vec_id")).agg(F.transform(F.array(*mean), lambda x: 32 * x).alias("features"))
    upper, left = (F.col("features")[0] + F.col("features")[k] for k in (1, 2))
    return rows.withColumns({"label": (upper * left > 0).cast("int"), "upper": (upper > 0).cast("int"), "held_out": F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0})


def kernel_machines(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    rows = Scratch(spark, "quadrants").save(_quadrants(spark, sf_dir), "rows")
    seen = rows.where("not held_out")
    gamma = learning.kernel_gamma(seen.withColumn("features", array_to_vector("features")), "scale")
    out = None
    for kernel, label in ((kernels.Kernel("rbf", gamma), "label"), (kernels.Kernel("poly", gamma, 2, 1.0), "label"), (kernels.Kernel("sigmoid", 0.1, coef0=-0.5), "upper")):
        machine = kernels.train_kernel_machine(seen, kernel, 1.0, tolerance=0.01, rounds=5 if kernel.name == "sigmoid" else 20, label=label)
        one = kernels.with_decisions(rows, machine).select("vec_id", F.lit(kernel.name).alias("kernel"), "held_out", F.col(label).alias("label"), (F.col("decision") > 0).cast("int").alias("prediction"))
        out = one if out is None else out.unionByName(one)
    return out


def network_scores(spark, sf_dir):
    rows = Scratch(spark, "quadrants").save(_quadrants(spark, sf_dir), "rows")
    model = network.train_network(rows.where("not held_out"), network.Training((16, 8), alpha=1e-2, learning_rate=0.02, batches=4, epochs=30))
    scored = network.with_probability(rows, model)
    return scored.select("vec_id", "held_out", "label", (F.col("score") > 0.5).cast("int").alias("prediction"), F.round("score", 4).alias("score"))


def grid_search_cv(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression

    estimator = LogisticRegression(maxIter=20)
    grid = learning.parameter_grid({estimator.regParam: [0.001, 0.1], estimator.elasticNetParam: [0.0, 1.0]})
    tuned = learning.tune(estimator, grid, _windows(spark, sf_dir), folds=5)
    names = [",".join(f"{p.name}={x}" for p, x in sorted(g.items(), key=lambda t: t[0].name)) for g in grid]
    return spark.createDataFrame([(n, round(float(m), 6)) for n, m in zip(names, tuned.avgMetrics, strict=True)], "params string, log_loss double")


def tuned_with_holdout(spark, sf_dir):
    """Rows that tuning did not see, scored by the best of a grid, with that setting's name."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = F.col("features")
    products = [x[i] * x[j] for i in range(4) for j in range(i, 4)]  # the label is a matter of products
    rows = _quadrants(spark, sf_dir).withColumn("features", array_to_vector(F.concat(x, F.array(*products)))).withColumn("label", F.col("label").cast("double"))
    rows = Scratch(spark, "holdout").save(rows.drop("held_out"), "rows")
    estimator = LogisticRegression(maxIter=30)
    grid = learning.parameter_grid({estimator.regParam: [1e-3, 1e-1, 10.0]})
    tuned, scored = learning.tune_with_holdout(estimator, grid, rows, "vec_id", folds=3)
    names = [",".join(f"{k.name}={value}" for k, value in g.items()) for g in grid]
    best = learning.best_of(list(zip(names, tuned.avgMetrics, strict=True)))
    return scored.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), F.round("score", 4).alias("score"), F.lit(best).alias("params"))


_DRAW = "md5(doc_id || '-{}')"
_ANGLES = f"""WITH {v.POINTS}, d AS (SELECT *, lag(y, 2) OVER w - y AS a1, lag(x, 2) OVER w - x AS b1, lead(y, 2) OVER w - y AS a2, lead(x, 2) OVER w - x AS b2 FROM points WINDOW w AS (PARTITION BY user_id ORDER BY i)),
a AS (SELECT user_id, i, x, y, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 0 ELSE atan2(a1 * a2 + b1 * b2, a1 * b2 - b1 * a2) END AS angle, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 0 ELSE atan2(-b1 - b2, -a1 - a2) END AS pointing FROM d)"""
_SPAN = "span AS (SELECT image_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM px64 GROUP BY 1)"
_MOVE = "radians(5.0) AS t, radians(2.0) AS s"
_CENTERED = """WITH p AS (SELECT p_partkey, CAST(p_size + 20 AS DOUBLE) AS h, CAST(p_partkey % 97 + 30 AS DOUBLE) AS w FROM part),
q AS (SELECT *, CASE WHEN w / h / 2.15 < 1 THEN h ELSE w / 2.15 END AS sr, CASE WHEN w / h / 2.15 < 1 THEN h * 2.15 ELSE w END AS sc FROM p)"""

QUERIES = {
    "trim_percentile_pixels": (trim_percentile_pixels, f"WITH {v.PX64}, cut AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px64 GROUP BY 1) SELECT image_id, r, c, round(least(greatest(v, lo), hi), 6) AS v FROM px64 JOIN cut USING (image_id)"),
    "trim_percentile_lineitem": (trim_percentile_lineitem, "WITH cut AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey, least(greatest(l_extendedprice, lo), hi) AS v FROM lineitem JOIN cut USING (l_suppkey)) SELECT l_suppkey, count(*) AS n, round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(sum(v), 2) AS total FROM t GROUP BY 1"),
    "rescale_minmax": (rescale_minmax, f"WITH {v.PX64}, {_SPAN} SELECT image_id, r, c, round((v - lo) / (hi - lo), 6) AS v FROM px64 JOIN span USING (image_id)"),
    "equalize_hist": (equalize_hist, f"WITH {v.PX64}, {_SPAN}, b AS (SELECT image_id, r, c, n, least(floor((v - lo) / (hi - lo) * 64), 63) AS bin FROM px64 JOIN span USING (image_id)), k AS (SELECT image_id, bin, n, count(*) AS k FROM b GROUP BY 1, 2, 3), s AS (SELECT image_id, bin, sum(k) OVER (PARTITION BY image_id ORDER BY bin) / n AS v FROM k) SELECT image_id, r, c, round(s.v, 6) AS v FROM b JOIN s USING (image_id, bin)"),
    "standardize": (standardize, f"WITH {v.PX64}, m AS (SELECT image_id, avg(v) AS mean, stddev_pop(v) AS sd FROM px64 GROUP BY 1) SELECT image_id, r, c, round((v - mean) / (sd + 1e-7), 6) AS v FROM px64 JOIN m USING (image_id)"),
    "standardize_orders": (standardize_orders, "WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1) SELECT o_orderkey, o_orderpriority, round((o_totalprice - mean) / (sd + 1e-7), 6) AS v FROM orders JOIN m USING (o_orderpriority)"),
    "background_difference": (background_difference, f"WITH {v.PX64}, {v.above_sql('fg', 0.7)}, g AS (SELECT image_id, avg(v) AS ground FROM px64 WHERE (image_id, r, c) NOT IN (SELECT image_id, r, c FROM fg) GROUP BY 1) SELECT image_id, r, c, round(abs(v - ground), 6) AS v FROM px64 JOIN g USING (image_id)"),
    "gray_from_channels": (gray_from_channels, f"WITH {v.PX8}, w AS (SELECT image_id // 3 AS image_id, r, c, max(v) FILTER (image_id % 3 = 0) AS a, max(v) FILTER (image_id % 3 = 1) AS b, max(v) FILTER (image_id % 3 = 2) AS d FROM px8 GROUP BY 1, 2, 3) SELECT image_id, r, c, round((0.2125 * a + 0.7154 * b + 0.0721 * d) / 255, 8) AS v FROM w"),
    "price_histogram": (price_histogram, "SELECT l_returnflag, CAST(least(floor(round(l_discount * 100, 0) / 2), 4) AS INT) AS bin, round(sum(l_quantity), 2) AS total FROM lineitem WHERE round(l_discount * 100, 0) BETWEEN 0 AND 10 GROUP BY 1, 2"),
    "value_counts_rank_2_16": (value_counts_rank_2_16, "SELECT source, n, CAST(rank AS INT) AS rank FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents WHERE source IS NOT NULL GROUP BY 1) WHERE rank BETWEEN 2 AND 16"),
    "describe_string": (describe_string, "WITH k AS (SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, (SELECT p_type FROM k ORDER BY n DESC, p_type LIMIT 1) AS top, max(n) AS freq FROM k"),
    "n_unique": (n_unique, "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM documents"),
    "split_by_ratio": (split_by_ratio, f"WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(100)}, doc_id) AS nth, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN nth <= CAST(floor(n * 0.7) AS INT) THEN 'train' ELSE 'test' END AS split FROM s WHERE nth <= CAST(floor(n * 0.7) AS INT) + CAST(floor(n * 0.25) AS INT)"),
    "split_stratified": (split_stratified, f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(1)}, doc_id) AS nth, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE nth <= floor(n * 0.25 + 0.5)"),
    "oversample_16": (oversample_16, "SELECT doc_id, CAST(k AS INT) AS copy FROM labels, (SELECT unnest(range(1, 17)) AS k) WHERE toxic = 1"),
    "mini_batches": (mini_batches, "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS INT) AS batch FROM labels"),
    "golden_else_model": (golden_else_model, "SELECT doc_id, CAST(quality AS INT) AS x FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "contour_angle": (contour_angle, f"{_ANGLES} SELECT user_id, i, x, round(y, 6) AS y, round(angle, 6) AS angle, round(pointing, 6) AS pointing FROM a"),
    "contour_extrema": (contour_extrema, f"{_ANGLES}, n AS (SELECT *, min(angle) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS lo, min(angle) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS hi FROM a) SELECT user_id, i, x, round(y, 6) AS y, round(angle, 6) AS angle, round(pointing, 6) AS pointing FROM n WHERE angle < lo AND angle < hi AND angle < -0.01"),
    "bounding_rectangle": (bounding_rectangle, f"WITH {v.POINTS} SELECT user_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY 1"),
    "affine_coords": (affine_coords, f"""WITH {v.POINTS}, k AS (SELECT *, {_MOVE} FROM points), z AS (SELECT *, (y - 3.0) / 0.9 AS zy, (x + 4.0) / 0.95 AS zx FROM k), h AS (SELECT *, zy + sin(s) * zx AS hy, cos(s) * zx AS hx FROM z)
SELECT user_id, i, CAST(trunc(-sin(t) * hy + cos(t) * hx) AS INT) AS x, CAST(trunc(cos(t) * hy + sin(t) * hx) AS INT) AS y FROM h"""),
    "center_transform": (center_transform, f"{_CENTERED} SELECT p_partkey, round(sr / 128, 6) AS m00, 0.0::DOUBLE AS m01, round(h / 2 - sr / 2, 6) AS m02, 0.0::DOUBLE AS m10, round(sc / 128, 6) AS m11, round(w / 2 - sc / 2, 6) AS m12 FROM q"),
    "clamp_bbox": (clamp_bbox, "WITH b AS (SELECT l_orderkey, l_linenumber, greatest(l_partkey % 80 - 20, 0) AS u0, greatest(l_suppkey % 70 - 20, 0) AS v0, least(l_partkey % 90, 50) AS u1, least(l_orderkey % 85, 60) AS v1 FROM lineitem), e AS (SELECT *, u0 >= u1 OR v0 >= v1 AS none FROM b) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN none THEN 0 ELSE u0 END AS INT) AS u0, CAST(CASE WHEN none THEN 0 ELSE v0 END AS INT) AS v0, CAST(CASE WHEN none THEN 50 ELSE u1 END AS INT) AS u1, CAST(CASE WHEN none THEN 60 ELSE v1 END AS INT) AS v1 FROM e"),
    "bilinear_center": (bilinear_center, f"WITH {v.PX8}, {v.bilinear_sql()} SELECT image_id, r, c, round(v, 6) AS v FROM moved"),
    "mlp_train_score": (mlp_train_score, None),
    "svm_rff_train_score": (svm_rff_train_score, None),
    "kernel_machines": (kernel_machines, None),
    "network_scores": (network_scores, None),
    "tuned_with_holdout": (tuned_with_holdout, None),
    "grid_search_cv": (grid_search_cv, None),
}
