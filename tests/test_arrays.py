"""Windows as `.npy` shards, written and read again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.sources import arrays

SCHEMA = "image_id string, k long, height int, width int, n_channels int, data array<double>"


@pytest.fixture(scope="module")
def windows(spark):
    arrays.register(spark)
    rows = [(f"i{k}", k, 2, 3 + k % 2, 1, [float(k * j) for j in range(2 * (3 + k % 2))]) for k in range(50)]
    return spark.createDataFrame([*rows, (None, None, 1, 1, 3, [1.0, 2.0, 3.0])], SCHEMA)


def same(a, b):
    key = lambda r: (r.k is None, r.k)
    return sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def test_round_trip(spark, windows, tmp_path):
    at = f"file://{tmp_path}/w"
    windows.repartition(3).write.format("npy").option("shard_bytes", 400).mode("append").save(at)
    read = spark.read.format("npy").schema(SCHEMA)
    assert same(read.load(at), windows)
    assert same(read.option("shape", "2x4x1").load(at), windows.where("width = 4"))
    assert spark.read.format("npy").schema("k long, width long").option("shape", "2x4x1").load(at).agg(F.sum("k"), F.max("width")).first() == (625, 4)
    assert read.option("shape", "9x9x9").load(at).count() == 0
    shards = list((tmp_path / "w").glob("2x3x1/*.npy"))
    assert len(shards) > 3 and sum(len(np.load(s)) for s in shards) == 25 and np.load(shards[0]).shape[1:] == (2, 3, 1)
    assert not (tmp_path / "w" / "_making").exists()
    windows.where("k < 2").write.format("npy").mode("overwrite").save(at)
    assert same(spark.read.format("npy").schema(SCHEMA).load(at), windows.where("k < 2"))


def test_failed_writes_leave_nothing(spark, windows, tmp_path):
    at = f"file://{tmp_path}/w"
    windows.where("k < 3").write.format("npy").mode("append").save(at)
    wrong = windows.repartition(4).withColumn("data", F.when(F.col("k") == 30, F.array(F.lit(1.0))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="not of its shape"):
        wrong.write.format("npy").option("shard_bytes", 100).mode("append").save(at)
    assert same(spark.read.format("npy").schema(SCHEMA).load(at), windows.where("k < 3"))
    assert not (tmp_path / "w" / "_making").exists()


def test_killed_attempts_are_not_read(spark, windows, tmp_path):
    """What an attempt wrote before it was lost stays out, and its task's second attempt is whole."""
    at = f"{tmp_path}/w"
    writer = arrays._Writer({"path": at}, False)
    batches = windows.where("k < 5").toArrow().to_batches()
    writer.write(iter(batches))  # lost
    writer.commit([writer.write(iter(batches)), None])
    assert same(spark.read.format("npy").schema(SCHEMA).load(f"file://{at}"), windows.where("k < 5"))
    assert not (tmp_path / "w" / "_making").exists()
    with pytest.raises(ValueError, match="no columns"):
        arrays.ArrayFiles({"path": at}).writer(windows.drop("height").schema, False)
