"""Sharding by sampled splitters, in DataFrame operations only.

A size-weighted sample of key hashes gives quantile boundaries, and records are
dealt to the ranges between them.  Ranges that turn out overfull are subdivided
by key, and a key that is overfull alone by record.  The exact bytes and rows of
these cells then place every record on one line of bytes, on which equal texts
stand together, and which is cut into shards between texts.  Groups of equal
texts that would make shards uneven go whole to the least filled shard, the
largest first, and the line's cuts fill up what they leave.
"""

from __future__ import annotations

import heapq

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table

_UNIT = 1 << 30
#: Ranges follow the rows; their number, and so the sample and what is broadcast, is bounded.
ROWS_PER_RANGE, MOST_RANGES = 1_000_000, 1 << 14
#: Equal texts above this share of a shard's mean bytes are given a shard before all others; only groups larger than a shard part.
SLACK = 0.01


def splitters(rows: DataFrame, n_ranges: int, per_range: int, total: int) -> list[float]:
    """Inner boundaries of about equal bytes, from a size-weighted sample of keys.

    The sample has n_ranges * per_range rows in expectation at any input size,
    so the driver holds no more than that.
    """
    weight = F.col("size") * F.lit(n_ranges * per_range / total)
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(17)), F.lit(_UNIT)) / _UNIT
    sample = rows.where(draw < weight).select(F.col("key").cast("double").alias("key"), F.greatest(weight, F.lit(1.0)).alias("weight")).collect()
    step, seen, cuts = sum(r.weight for r in sample) / n_ranges, 0.0, []
    for r in sorted(sample):
        seen += r.weight
        if seen >= step * (len(cuts) + 1) and len(cuts) < n_ranges - 1:
            cuts.append(r.key)
            while seen >= step * (len(cuts) + 1) and len(cuts) < n_ranges - 1:
                cuts.append(r.key)
    return sorted(set(cuts))


def _homes(groups: list[tuple[int, int]], n_shards: int) -> tuple[dict[int, int], list[int]]:
    """A shard for each of (bytes, key), the largest first to the least filled, and what each shard then holds."""
    filled = [(0, s) for s in range(n_shards)]
    home = {}
    for size, key in sorted(groups, reverse=True):
        held, s = heapq.heappop(filled)
        home[key] = s
        heapq.heappush(filled, (held + size, s))
    return home, [held for held, s in sorted(filled, key=lambda at: at[1])]


def _edges(held: list[int], rest: int) -> list[tuple[int, float]]:
    """(shard, where it ends on a line of `rest` bytes), so that the line fills shards up to one level."""
    level, below = 0.0, 0
    for n, size in enumerate(sorted(held), 1):
        below += size
        if n == len(held) or (rest + below) / n <= sorted(held)[n]:
            level = (rest + below) / n
            break
    out, upto = [], 0.0
    for s, size in enumerate(held):
        if size < level:
            upto += level - size
            out.append((s, upto))
    return out


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, ranges_per_shard: int = 16, per_range: int = 32, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs.

    size is the text's UTF-8 bytes plus 1.  Shards are cut from one order of
    all records by text hash, so their sizes differ by about one document, or
    by SLACK, unless groups of equal texts leave no such choice.  Equal texts
    are in one shard unless they have more bytes than a shard.  Those above
    SLACK, at most n_shards / SLACK groups, are placed on the driver by their
    sizes.  A null text has no bytes (size 1,
    crc 0); null and repeated ids, ties and repeated rows are each placed once;
    an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.save(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), "keys")
    n_rows, total = rows.agg(F.count("*"), F.sum("size")).first()
    n_rows, total = max(n_rows, 1), total or 1
    n_ranges = max(n_shards * ranges_per_shard, min(MOST_RANGES, n_rows // ROWS_PER_RANGE))
    cuts = [-float("inf"), *splitters(rows, n_ranges, per_range, total), float("inf")]
    dealt = rows.withColumn("at", F.col("key").cast("double"))
    dealt = Bucketizer(splits=cuts, inputCol="at", outputCol="range").transform(dealt) if len(cuts) > 2 else dealt.withColumn("range", F.lit(0.0))
    dealt = dealt.drop("at").withColumn("range", F.col("range").cast("int"))
    # how often bytes and rows fill a mean range; a key that fills one alone is a cell of its own, in parts
    fill = F.greatest(F.sum("bytes") * F.lit(n_ranges / total), F.sum("n") * F.lit(n_ranges / n_rows))
    by_key = scratch.save(dealt.groupBy("range", "key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "by-key")
    one = F.greatest(F.col("bytes") * F.lit(n_ranges / total), F.col("n") * F.lit(n_ranges / n_rows))
    mean = total / n_shards
    large = by_key.where((F.col("bytes") > SLACK * mean) & (F.col("bytes") <= mean))
    home, held = _homes([(r.bytes, r.key) for r in large.select("bytes", "key").collect()], n_shards)  # at most n_shards / SLACK rows
    homes = spark.createDataFrame(list(home.items()), "key long, home int")
    hot = by_key.withColumn("fill", one).join(F.broadcast(homes), "key", "left").where("fill > 1 or home is not null")
    hot = hot.select("range", F.col("key").alias("hot"), F.col("bytes").alias("group_bytes"), F.ceil("fill").cast("int").alias("pieces"), "home")
    hot = scratch.save(hot, "hot")  # at most twice n_ranges rows, and the large ones
    cool = by_key.join(F.broadcast(hot.select("range", F.col("hot").alias("key"))), ["range", "key"], "left_anti").groupBy("range").agg(F.ceil(fill / 2).cast("int").alias("parts"))  # at most n_ranges rows
    dealt = dealt.join(F.broadcast(hot), (dealt.range == hot.range) & (dealt.key == hot.hot), "left").drop(hot.range).join(F.broadcast(cool), "range", "left")
    part = F.when(F.col("hot").isNull(), F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts"))).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(5)), F.col("pieces"))).cast("int")
    # cells in order: a range's parts, then its hot keys' pieces, one after another; last the groups that have a shard
    cell = ["home", "range", "hot", "part"]
    dealt = dealt.withColumn("part", part)
    line = Window.orderBy(F.col("home").asc_nulls_first(), "range", F.col("hot").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each cell, of which there are about four times n_ranges at most
    before = dealt.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = before.withColumns({"bytes_before": F.coalesce(F.sum("bytes").over(line), F.lit(0)), "rows_before": F.coalesce(F.sum("n").over(line), F.lit(0))}).drop("bytes", "n")
    before = before.withColumn("hot_before", F.min("bytes_before").over(Window.partitionBy("range", "hot")))
    within = Window.partitionBy(*cell).orderBy("key", "doc_id", "text_crc32", "size")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"run": F.sum("size").over(upto), "nth": F.count(F.lit(1)).over(upto)})
    same = Window.partitionBy(*cell, "key")
    placed = placed.withColumns({"own_bytes": F.sum("size").over(same), "own_end": F.max("run").over(same)})
    placed = placed.alias("p").join(F.broadcast(before).alias("b"), (F.col("p.range") == F.col("b.range")) & F.col("p.hot").eqNullSafe(F.col("b.hot")) & (F.col("p.part") == F.col("b.part")))  # a hot key has one home
    group_middle = F.when(F.col("p.hot").isNull(), F.col("bytes_before") + F.col("own_end") - F.expr("own_bytes div 2") - 1).otherwise(F.col("hot_before") + F.expr("group_bytes div 2"))
    middle = F.when(F.coalesce("group_bytes", "own_bytes") <= mean, group_middle).otherwise(F.col("bytes_before") + F.col("run") - F.expr("size div 2") - 1)
    placed = placed.select("doc_id", "size", "text_crc32", "p.home", middle.cast("double").alias("middle"), (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    edges = _edges(held, total - sum(held)) or [(0, 0.0)]
    cuts = sorted({upto for _, upto in edges[:-1]})  # shards that the large groups fill have no part of the line
    placed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="middle", outputCol="nth_part").transform(placed) if cuts else placed.withColumn("nth_part", F.lit(0.0))
    of_part = F.element_at(F.array(*[F.lit(s) for s, _ in edges]), F.col("nth_part").cast("int") + 1)
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("home", of_part).cast("int").alias("shard"), F.col("home").isNotNull().alias("settled"), "row")
    placed = scratch.save(placed, "placed")
    # 2 * n_shards rows: where a shard's records from the line, and those of its groups, begin
    first = placed.groupBy("shard", "settled").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("settled").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("shard", "settled", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(first), ["shard", "settled"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in 16 shards of near equal bytes."""
    return shard_by_bytes(read_table(spark, sf_dir, "documents"))
