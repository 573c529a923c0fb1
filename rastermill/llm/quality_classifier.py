"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of each text, standardised, pass through random cosines whose inner
products approximate a Gaussian kernel.  Each partition sums its part of the
normal equations and a tree adds them up; the driver solves one system of fixed
size.  Labelled rows kept aside from the fit calibrate the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from .quality_rules import text_counts
from .words import SPACED, chunks, split_words

_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "space": ~SPACED,
    "stop": np.isin(np.arange(256), [ord(c) for c in ".!?"]),
    "comma": np.isin(np.arange(256), [ord(c) for c in ",;:"]),
    "bang": np.isin(np.arange(256), [ord("!")]),
    "other": np.isin(np.arange(256), [ord(c) for c in "#$%&*+/<=>@[]^_{|}~\\"]),
    "high": np.arange(256) >= 128,
    "line": np.arange(256) == 10,
}
N_STATISTICS = 24


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Statistics of each text, one row each; ratios of an empty text are 0."""
    n = len(off) - 1
    size = np.diff(off)
    c = text_counts(data, off, 0)
    words = split_words(data, off, SPACED, True)
    text = words.text_of()
    n_words, w = c["n_words"], np.maximum(c["n_words"], 1)
    per = {}
    for name, kind in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(kind[data])])
        per[name] = total[off[1:]] - total[off[:-1]]
    b = np.maximum(size, 1)
    length = words.end - words.start
    order = np.lexsort((words.hash, text))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order[new]], minlength=n)
    upper = _CLASSES["upper"][data] if len(data) else np.zeros(0, bool)
    total_upper = np.concatenate([[0], np.cumsum(upper)])
    upper_in = total_upper[words.end] - total_upper[words.start]
    mean = np.bincount(text, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(text, length.astype(float) ** 2, n) / w - mean**2, 0))
    capital = np.bincount(text[upper[words.start]] if len(words.start) else text, minlength=n)
    shouted = np.bincount(text[upper_in * 2 > length], minlength=n)
    long = np.bincount(text[length > 15], minlength=n)
    short = np.bincount(text[length < 3], minlength=n)
    cells = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256) / b[:, None]
    entropy = -(cells * np.log2(np.maximum(cells, 1e-12))).sum(1)
    lines = per["line"] + 1
    columns = [
        np.log1p(n_words), mean, spread, distinct / w, c["n_repeat_words"] / w, c["n_dup_lines"] / lines, c["n_symbols"] / b, np.log1p(lines), np.log1p(n_words / lines),
        per["upper"] / b, per["lower"] / b, per["digit"] / b, per["space"] / b, per["stop"] / w, per["comma"] / w, per["bang"] / w, per["other"] / b, per["high"] / b,
        capital / w, shouted / w, long / w, short / w, entropy, np.log1p(per["other"] + per["bang"]),
    ]
    return np.stack(columns, 1).astype(np.float64)


@dataclass
class Model:
    """Standardisation, random cosines, ridge weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([f, np.ones((len(f), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0.0, 1.0)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in chunks(batch.column(1)):
            x = statistics(data, off)
            values = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), values], names=["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()).reshape(-1, N_STATISTICS)


def _equations(model) -> object:
    """Per partition: the sums of feature products and of features times labels, as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                f, y = model.value.features(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float)
                part = np.concatenate([f.T @ f, (f.T @ y)[None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})


def _isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins at x with n rows, of which `ones` are labelled 1."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, n, ones, strict=True):
        blocks.append([a * b, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _raw_scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.value.raw(_matrix(batch.column(0)))), batch.column(1)], names=["raw", "quality"])

    return run


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.score(_matrix(batch.column(2))))], names=["doc_id", "held_out", "score"])

    return run


def fit(labelled: DataFrame, cosines: int = 256, gamma: float = 0.02, ridge: float = 1e-3, bins: int = 4096, seed: int = 3) -> Model:
    """From rows (doc_id, x, quality): a fifth calibrates, the rest fits the ridge."""
    spark = labelled.sparkSession
    moments = [f(F.col("x")[k]) for k in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)]
    row = labelled.agg(*moments).first()
    mean = np.array([v or 0.0 for v in row[0::2]])
    scale = np.maximum(np.array([v or 0.0 for v in row[1::2]]), 1e-6)
    random = np.random.default_rng(seed)
    frequency = random.normal(size=(N_STATISTICS, cosines)) * np.sqrt(2 * gamma)
    model = Model(mean, scale, frequency, random.uniform(0, 2 * np.pi, cosines), np.zeros(cosines + 1))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0
    sums = labelled.where(~aside).select("x", "quality").mapInArrow(_equations(spark.sparkContext.broadcast(model)), "sums binary")
    branches = max(1, int(labelled.rdd.getNumPartitions() ** 0.5))
    sums = sums.repartition(branches).mapInArrow(_add, "sums binary").repartition(1).mapInArrow(_add, "sums binary").collect()
    if not sums:  # nothing to learn from: every score is 0.5
        return model
    total = np.frombuffer(sums[0].sums, np.float64).reshape(cosines + 2, cosines + 1)
    rows = total[cosines, cosines]
    model.weights = np.linalg.solve(total[:-1] + ridge * rows * np.eye(cosines + 1) / cosines, total[-1])
    raw = labelled.where(aside).select("x", "quality").mapInArrow(_raw_scores(spark.sparkContext.broadcast(model)), "raw double, quality int")
    binned = raw.groupBy(F.floor(F.least(F.greatest(F.col("raw"), F.lit(-1.0)), F.lit(2.0)) * (bins / 3)).alias("bin")).agg(F.avg("raw").alias("x"), F.count("*").alias("n"), F.sum("quality").alias("ones"))
    found = sorted(binned.collect(), key=lambda r: r.x)  # at most bins + 1 rows
    if found:
        model.steps = _isotonic(*(np.array([r[k] for r in found], float) for k in ("x", "n", "ones")))
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    held_out is a boolean column over docs; labels of those rows aren't used.
    Null and empty texts are scored as texts without words.  Null labels are
    left out, repeated ones all count, labels without a document don't; null
    ids are scored but never learnt from; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "classifier")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    x = scratch.save(rows.mapInArrow(_statistics_of, "doc_id long, x array<double>"), "statistics")
    x = x.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null")
    labelled = scratch.save(x.where(~F.col("held_out")).join(known, "doc_id").select("doc_id", "x", "quality"), "labelled")
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))
    scored = x.select("doc_id", "held_out", "x").mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, scored by what `labels` marks outside the held-out quarter of ids."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held_out)
