"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents share one copy rate.  Its whole part is taken outright;
the fractional parts are paired, and each pair randomly transfers mass, weighed
by size, until one of the two is integral.  That keeps every document's
expected copies and the source's words.  Pairs meet inside small groups first;
each group leaves at most one fractional document, and these residuals meet in
further rounds of a reduction tree until each source has one left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from ..operators.ordinals import numbered, running_sums

#: Documents, or residuals, that one group of the tree rounds.
GROUP = 2048


def source_targets(totals: DataFrame, weights: tuple[int, ...], most: float, scratch: Scratch | None = None) -> DataFrame:
    """Rows (source, source_size, n, target, source_at) from (source, source_size, n); source_at is the source's place in their order.

    Sources by code point, null last, weigh `weights` repeating and share all
    sizes; no target is above `most` times its source's size, and the excess is
    shared by weight among the others until none is above.  Sources are ordered
    by ranges, so their number may be any.
    """
    by_name = F.col("source").asc_nulls_last()
    w = numbered(totals, [by_name], "source_at", scratch)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_at") - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumns({"ceiling": F.col("source_size") * F.lit(float(most))}).withColumns({"reached": F.col("ceiling") / F.col("weight"), "full": F.col("ceiling"), "taken": F.col("weight")})
    # the sources that reach their ceilings first come first; each of those is full at the level left to it
    w = running_sums(w, [], ["reached", by_name], ["full", "taken"], scratch)
    total, weight = w.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(total or 0)) - (F.col("full") - F.col("ceiling"))) / (F.lit(float(weight or 1)) - (F.col("taken") - F.col("weight")))
    w = w.withColumn("level", level).withColumn("capped", F.col("reached") <= F.col("level"))
    first = w.where("not capped").agg(F.min(F.struct("reached", "level"))).first()[0]
    target = F.least("ceiling", F.lit(first.level if first else 0.0) * F.col("weight"))
    return w.select("source", "source_size", "n", F.when(F.col("capped"), F.col("ceiling")).otherwise(target).alias("target"), F.col("source_at").cast("int").alias("source_at"))


_STATE = "doc_id long, row_key long, source_at int, size long, source_size long, target double, whole int, u double, p double, bucket long"


def _round_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Pair the group's fractional documents until at most one is left.

    Larger documents meet first: those of like size settle each other, so the
    one left in the end is small, and with it what the source is off its target.
    """
    rows = rows.sort_values(["size", "u", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    p, size, u = rows["p"].tolist(), rows["size"].tolist(), rows["u"].tolist()
    i = None
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if i is None:
            i = j
            continue
        up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        # draws of both documents, so that a document's order and its draw are not tied
        if (u[i] * 7919 + u[j] * 104729) % 1.0 * (up + down) < down:
            first_full = (1 - p[i]) * size[i] <= p[j] * size[j]
            p[i], p[j] = (1.0, p[j] - up / size[j]) if first_full else (p[i] + up / size[i], 0.0)
        else:
            first_empty = p[i] * size[i] <= (1 - p[j]) * size[j]
            p[i], p[j] = (0.0, p[j] + down / size[j]) if first_empty else (p[i] - down / size[i], 1.0)
        p[i], p[j] = min(max(p[i], 0.0), 1.0), min(max(p[j], 0.0), 1.0)
        left = [k for k in (i, j) if 0.0 < p[k] < 1.0]
        i = left[0] if left else None
    rows["p"] = p
    return rows


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, row_key, size, source_size, target, copies, taken), one for each row of docs.

    size counts the words of the text (null: 0), copies is how often the mix
    takes the document (0 to `most`), taken its words in the mix.  Draws hang
    on the id and the text, so reruns agree.  A null source is a source of its
    own; sources without words have target 0 and no copies; documents without
    words take 0; repeated rows and ids are rounded one by one; an empty table
    gives no rows.  row_key is a hash of the text.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    text = F.col(text_col)
    rows = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("row_key"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ), "sizes",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = scratch.save(source_targets(totals, weights, most, scratch), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    state = rows.join(targets, rows.source.eqNullSafe(targets.source)).select(
        "doc_id", "row_key", "source_at", "size", "source_size", "target", F.floor(rate).cast("int").alias("whole"),
        (F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("u"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"),
        F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed + 1)), F.ceil(F.col("n") / GROUP)).cast("long").alias("bucket"),
    )
    n = targets.agg(F.max("n")).first()[0] or 0
    width, turn, done = -(-n // GROUP), 0, []
    while True:
        state = scratch.save(state.groupBy("source_at", "bucket").applyInPandas(_round_group, _STATE), f"round-{turn}")
        left = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.where(~left))
        state = state.where(left)
        if width <= 1:
            break
        width, turn = -(-width // GROUP), turn + 1
        state = state.withColumn("bucket", F.expr(f"bucket div {GROUP}"))
    done.append(state.withColumn("p", (F.col("u") < F.col("p")).cast("double")))  # one for each source at most
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("int")
    return every.select("doc_id", "row_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, mixed to the weights 1, 2, 3 of its sources."""
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them."""
    keys = ["doc_id", "row_key", "nth"]
    nth = Window.partitionBy("doc_id", "row_key").orderBy("row_key")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64("text").alias("row_key")).withColumn("nth", F.row_number().over(nth))
    copies = mixed.select("doc_id", "row_key", "copies").withColumn("nth", F.row_number().over(nth)).where("copies > 0")
    on = [rows[k].eqNullSafe(copies[k]) for k in keys]
    return rows.join(copies, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
