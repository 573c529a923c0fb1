"""Running scores of images as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import with_precision


def running_totals(scores: DataFrame) -> DataFrame:
    """Totals by threshold of a stream of image scores (image_id, threshold, tp, fp, fn), with their precision.

    The state is a row for each threshold, whatever the number of images.
    """
    return with_precision(scores.groupBy("threshold").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")]))


def write_totals(scores: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the newest totals as Parquet under path, replaced as a whole by each batch."""

    def replace(totals: DataFrame, batch: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(path)  # a row for each threshold

    writer = running_totals(scores).writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
