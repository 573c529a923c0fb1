"""Features of windows: raw values, Gaussian kernel products, histograms of gradients."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbourhood as nb

KEY = nb.KEY
#: Default sigmas of the Gaussian kernels, and default options of histograms of gradients.
SIGMAS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
HOG = {"orientations": 9, "pixels_per_cell": 8, "cells_per_block": 2}


def hog_descriptor(pixels: DataFrame, images: DataFrame, orientations: int = 9, pixels_per_cell: int = 8, cells_per_block: int = 2) -> DataFrame:
    """Rows (image_id, br, bc, k, value): blocks of cells' orientation histograms, normalised to length 1, cut at 0.2 and normalised again.

    Gradients are central differences, 0 at the border; orientations are
    unsigned; a cell's sums are divided by its pixels; blocks step by one cell.
    """
    across, down = Window.partitionBy(KEY, "r").orderBy("c"), Window.partitionBy(KEY, "c").orderBy("r")
    slope = lambda w: F.coalesce(F.lead("v").over(w) - F.lag("v").over(w), F.lit(0.0))
    rows = pixels.select(KEY, "r", "c", slope(across).alias("gx"), slope(down).alias("gy"))
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0))
    at = F.least(F.floor(angle / (180 / orientations)), F.lit(orientations - 1)).cast("int")
    cell = lambda x: F.floor(F.col(x) / pixels_per_cell).cast("int")
    sums = rows.groupBy(KEY, cell("r").alias("cr"), cell("c").alias("cc"), at.alias("bin")).agg((F.sum(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)) / pixels_per_cell**2).alias("total"))
    blocks = lambda n: F.sequence(F.lit(0), F.floor(F.col(n) / pixels_per_cell).cast("int") - cells_per_block)
    fits = images.where((F.col("height") >= pixels_per_cell * cells_per_block) & (F.col("width") >= pixels_per_cell * cells_per_block))
    grid = fits.select(KEY, "width", F.explode(blocks("height")).alias("br")).select(KEY, "br", F.explode(blocks("width")).alias("bc"))
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(cells_per_block) for b in range(cells_per_block)])
    grid = grid.withColumn("p", F.explode(parts)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(orientations - 1))))
    k = (F.col("p.a") * cells_per_block + F.col("p.b")) * orientations + F.col("bin")
    grid = grid.select(KEY, "br", "bc", k.alias("k"), "bin", (F.col("br") + F.col("p.a")).alias("cr"), (F.col("bc") + F.col("p.b")).alias("cc"))
    out = grid.join(sums, [KEY, "cr", "cc", "bin"], "left").fillna(0.0, ["total"])
    by = Window.partitionBy(KEY, "br", "bc")
    unit = lambda c: F.col(c) / F.sqrt(F.sum(F.col(c) ** 2).over(by) + 1e-10)
    out = out.withColumn("value", F.least(unit("total"), F.lit(0.2)))
    return out.withColumn("value", unit("value")).select(KEY, "br", "bc", "k", "value")


def window_features(windows: DataFrame, keys: list[str], height: int, width: int, method: str = "pixelval", options: dict | None = None) -> DataFrame:
    """Rows (keys, features) from window pixels (keys, wr, wc, v).

    pixelval: the values row by row.  gkhp: for each of `sigmas` the sum of
    values times a Gaussian kernel.  hog: histograms of gradients; options
    override their defaults.
    """
    options = options or {}
    whole = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[order[-1]])
    if method == "pixelval":
        rows = windows.groupBy(*keys).agg(whole(["wr", "wc", "v"]).alias("x"))
    elif method in ("gkhp", "hog"):
        own = windows.select(F.struct(*keys).alias(KEY), F.col("wr").alias("r"), F.col("wc").alias("c"), "v")
        if method == "gkhp":
            found = nb.gaussian_features(own, height, width, tuple(options.get("sigmas", SIGMAS))).groupBy(KEY).agg(whole(["sigma", "feature"]).alias("x"))
        else:
            sizes = own.select(KEY).distinct().select(KEY, F.lit(height).alias("height"), F.lit(width).alias("width"))
            found = hog_descriptor(own, sizes, **HOG | options).groupBy(KEY).agg(whole(["br", "bc", "k", "value"]).alias("x"))
        rows = found.select(f"{KEY}.*", "x")
    else:
        raise ValueError(f"unknown features: {method}")
    return rows.select(*keys, array_to_vector("x").alias("features"))


class WindowFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that adds `features` to windows whose values are an array column, told apart by an id column."""

    idCol = Param(Params._dummy(), "idCol", "column that tells windows apart", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "array of values, row by row", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "pixelval, gkhp or hog", TypeConverters.toString)
    height = Param(Params._dummy(), "height", "rows of a window", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "columns of a window", TypeConverters.toInt)
    sigmas = Param(Params._dummy(), "sigmas", "of the kernels of gkhp", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, idCol="vec_id", inputCol="image_matrix", method="pixelval", height=8, width=8, sigmas=SIGMAS):
        super().__init__()
        self._setDefault(idCol="vec_id", inputCol="image_matrix", method="pixelval", height=8, width=8, sigmas=list(SIGMAS))
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, idCol=None, inputCol=None, method=None, height=None, width=None, sigmas=None):
        return self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values, method, width = self.getOrDefault("inputCol"), self.getOrDefault("method"), self.getOrDefault("width")
        if method == "pixelval":
            return dataset.withColumn("features", array_to_vector(F.col(values).cast("array<double>")))
        own = self.getOrDefault("idCol")
        pixels = dataset.select(own, F.posexplode(values).alias("p", "v")).select(own, F.expr(f"p div {width}").cast("int").alias("wr"), (F.col("p") % width).alias("wc"), F.col("v").cast("double").alias("v"))
        options = {"sigmas": self.getOrDefault("sigmas")} if method == "gkhp" else {}
        return dataset.join(window_features(pixels, [own], self.getOrDefault("height"), width, method, options), own)

