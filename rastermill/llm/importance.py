"""Importance resampling toward a target: hashed n-gram features whose CRCs come from their words' CRCs.

A feature's bucket is the CRC-32 of its words joined by spaces.  CRC-32 is
linear over GF(2): that of a joined text is the first part's, moved on by a
matrix power that hangs on the second part's length, xor the second part's.
So a word's CRC is computed once, those of all runs of words follow by matrix
lookups, and no run is ever spelt out.

Bucket counts are summed within tasks before they are shuffled, a row for each
task and bucket; what is broadcast is one gain for each bucket, whose number is
a parameter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from ..operators.ordinals import numbered
from .words import ALNUM, pieces, text_bytes

#: The reflected polynomial of CRC-32 (a fixed value).
POLYNOMIAL = 0xEDB88320
#: Words of more bytes go to zlib one by one.
SHORT = 32


@dataclass(frozen=True)
class Resampling:
    """longest: words of the longest feature; percent: share of the documents of at least `least_words` words that is drawn."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


@cache
def _byte_steps() -> np.ndarray:
    """The register after one more byte, for each value of its low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return c


def _times(lookup: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, as lookups of its columns' sums by byte, times many 32-bit vectors."""
    return lookup[0][x & 255] ^ lookup[1][(x >> 8) & 255] ^ lookup[2][(x >> 16) & 255] ^ lookup[3][x >> 24]


@cache
def _shift(k: int) -> np.ndarray:
    """The matrix that moves a CRC on by 2^k zero bytes: four lookups of 256 values."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k == 0:
        columns = _byte_steps()[units & 255] ^ (units >> np.uint32(8))
    else:
        columns = _times(_shift(k - 1), _times(_shift(k - 1), units))
    value = np.arange(256)
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where((value >> bit) & 1, columns[8 * byte + bit], np.uint32(0))
    return out


def moved_on(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC's share in that of a text which goes on for `lengths` more bytes."""
    crc = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = (lengths >> k) & 1 == 1
        crc[some] = _times(_shift(k), crc[some])
    return crc


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, a byte of all words at a time."""
    size = end - start
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    sizes, at = size[order], start[order]
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    steps = _byte_steps()
    long = int((sizes > SHORT).sum())
    for k in range(int(sizes[long:].max(initial=0))):
        n = int(np.searchsorted(-sizes[long:], -k)) + long  # words with a byte k
        now = crc[long:n]
        crc[long:n] = steps[(now ^ data[at[long:n] + k]) & 255] ^ (now >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def feature_crcs(texts: pa.Array, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, CRC of each run of n words, text it is in) for n up to `longest`, a piece of the texts at a time."""
    data, off = text_bytes(texts)
    kept = [np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # the last words of earlier pieces: CRC, bytes, text
    for here, start, end, text in pieces(data, off, ALNUM, True):
        crc, size = word_crcs(here, start, end), end - start
        before = len(kept[0])
        crc, size, text = (np.concatenate(x) for x in zip(kept, (crc, size, text), strict=True))
        spaced = moved_on(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
        run = crc
        for n in range(1, longest + 1):
            if n > 1:
                run = moved_on(run[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
            if not len(run):
                break
            whole = text[: len(run)] == text[n - 1 :]
            whole[: max(before - n + 1, 0)] = False  # runs within earlier pieces
            yield n, run[whole], text[: len(run)][whole]
        kept = [x[len(x) - min(longest - 1, len(x)) :] for x in (crc, size, text)]


def _bucket_counts(p: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for _, crc, _ in feature_crcs(batch.column(0), p.longest):
                total += np.bincount(crc % np.uint32(p.buckets), minlength=p.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, p: Resampling = Resampling(), text_col: str = "text") -> DataFrame:
    """Rows (bucket, n): features of all texts in each bucket that has any."""
    return texts.select(text_col).mapInArrow(_bucket_counts(p), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, p: Resampling = Resampling(), scratch: Scratch | None = None) -> DataFrame:
    """Rows (bucket, gain) for all buckets, from both sides' bucket counts: floor(1000 ln of the target's share over the raw share), each with one more in every bucket."""
    scratch = scratch or Scratch(raw.sparkSession, "gains")
    every = raw.sparkSession.range(p.buckets).withColumnRenamed("id", "bucket")
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = scratch.save(both, "buckets")
    of = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1.0) * float(of.s + p.buckets) / ((F.col("s") + 1.0) * float(of.t + p.buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weights(p: Resampling, gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            words, features, weight = (np.zeros(size, np.int64) for _ in range(3))
            for n, crc, text in feature_crcs(batch.column(1), p.longest):
                found = np.bincount(text, minlength=size)
                features += found
                words += found if n == 1 else 0
                np.add.at(weight, text, gain.value[crc % np.uint32(p.buckets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling(), scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank), one for each row of docs.

    weight sums the gains of the text's features; score adds a Gumbel draw that
    hangs on seed and id, so the highest scores are a sample without
    replacement whose chances follow exp(weight / 1000), and reruns agree.  Of
    the N rows with at least least_words words and an id, the floor(percent * N
    / 100) highest have ranks from 1; others have a null rank.  Ties go to the
    smaller id, then to fewer features and the lesser weight; rows equal in all
    take following ranks.  A null, empty or wordless text has no features and
    weight 0.  A null id has a null score and is not drawn, but its text counts
    among all texts.  Empty tables give no rows, or gains against nothing.
    Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "resampling")
    table = gains(bucket_counts(docs, p, text_col), bucket_counts(target, p, target_col), p, scratch).toArrow()  # a row for each bucket
    gain = np.zeros(p.buckets, np.int64)
    gain[table.column("bucket").to_numpy()] = table.column("gain").to_numpy()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_weights(p, spark.sparkContext.broadcast(gain)), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    drawn = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = scratch.save(rows.withColumn("score", F.col("weight") + drawn), "scored")
    may = (F.col("n_words") >= p.least_words) & F.col("doc_id").isNotNull()
    most = p.percent * rows.where(may).count() // 100
    order = [F.col("score").desc(), "doc_id", "n_features", "weight"]
    ranked = numbered(rows.where(may), order, "nth", scratch).withColumn("rank", F.when(F.col("nth") <= most, F.col("nth"))).drop("nth")
    return ranked.unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")))


def drawn_rows(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn, with all their columns."""
    chosen = resampled.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs[id_col].cast("long") == F.col("_drawn"), "left_semi")


def op11_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` resampled toward `benchmark` by single words."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("n_words")
