"""Totals of lines against their pixels."""

import re

from pyspark.sql import functions as F

from rastermill.operators import shapes
from rastermill.plans.catalog import QUERIES


def test_totals_are_those_of_the_pixels(spark):
    at = [-7, -1, 0, 2, 5, 12]
    ends = spark.createDataFrame([(a, b, c, d) for a in at for b in at for c in at for d in at], "a int, b int, c int, d int")
    found = shapes.line_totals(ends, "a", "b", "c", "d").select("a", "b", "c", "d", "n", "rows", "cols")
    p = ends.select("a", "b", "c", "d", F.explode(shapes.line(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).alias("p"))
    want = p.groupBy("a", "b", "c", "d").agg(F.count("*").alias("n"), F.sum("p.r").alias("rows"), F.sum("p.c").alias("cols"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_an_unknown_row_leaves_the_columns(spark):
    row = shapes.line_totals(spark.createDataFrame([(None, 1, 2, 3)], "a int, b int, c int, d int"), "a", "b", "c", "d").first()
    assert (row["n"], row["rows"], row["cols"]) == (3, None, 6)


def test_raster_lines_lists_no_pixels(spark, sf_dir):
    plan = QUERIES["raster_lines"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("transform\\(|aggregate\\(", plan)
