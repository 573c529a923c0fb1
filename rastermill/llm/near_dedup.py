"""MinHash near-duplicate detection with sequential Bayesian verification (after BayesLSH).

Texts become sets of word shingles.  Equal sets collapse into one class, so a
group of copies is one row from then on.  Classes that agree on all rows of a
signature band are candidates.  A candidate pair's signatures are compared a
batch at a time; once the posterior probability of reaching the similarity
falls to the chosen miss probability, the pair is pruned.  Survivors are
verified on their full sets, and verified links form components.

No group's pairs are emitted.  First every member of a band's bucket meets only
the bucket's least member.  Buckets that then still hold several components
are compared in blocks inside tasks, member against member of the other
components, and survivors are verified there.  So no link that would join two
components is left out, and at most one link for each member leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..functions.store import Scratch, read_table
from .words import SPACED, chunks, mix64, shingles, split_words


@dataclass(frozen=True)
class NearDedup:
    """Parameters: with 32 bands of 4 rows, a pair at similarity 0.8 meets in no band with probability 5e-8."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    block: int = 1024
    block_bytes: int = 1 << 24

    @property
    def size(self) -> int:
        return self.bands * self.rows


@cache
def _log_posterior_tail(agree: int, seen: int, percent: int) -> float:
    """P(similarity >= percent / 100) given agreeing signature rows, under a uniform prior."""
    grid = (np.arange(4000) + 0.5) / 4000
    a, b = agree + 1, seen - agree + 1
    log_density = (a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid) + lgamma(a + b) - lgamma(a) - lgamma(b)
    density = np.exp(log_density)
    return float(density[grid >= percent / 100].sum() / density.sum())


@cache
def least_agreement(seen: int, percent: int, miss: float) -> int:
    """Fewest agreeing rows of `seen` at which a pair isn't pruned: below, its posterior chance is under `miss`."""
    for agree in range(seen + 1):
        if _log_posterior_tail(agree, seen, percent) >= miss:
            return agree
    return seen


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    return a, mix64(np.arange(10_001, n + 10_001, dtype=np.uint64))


def _signatures(h: np.ndarray, first: np.ndarray, p: NearDedup) -> np.ndarray:
    """MinHash rows of each set, the low 16 bits of each minimum; set i is h[first[i] : first[i + 1]], none of them empty."""
    a, b = _permutations(p.size)
    out = np.empty((len(first), p.size), dtype=np.uint16)
    for k in range(p.size):
        least = np.minimum.reduceat((h * a[k] + b[k]) >> np.uint64(24), first)
        out[:, k] = (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _band_keys(sig: np.ndarray, p: NearDedup) -> np.ndarray:
    rows = sig.reshape(len(sig), p.bands, p.rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(500, 500 + p.bands, dtype=np.uint64)), (len(sig), p.bands)).copy()
    for r in range(p.rows):
        key = mix64(key * np.uint64(31) + rows[:, :, r])
    return key.view(np.int64)


def _binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The matrix whose rows a binary column holds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]].view(dtype).reshape(-1, width)


_FEATURES = "node long, text_hash long, n_shingles long, set_key binary, sig binary"


def _features(p: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in chunks(batch.column(2)):
                h, text = shingles(split_words(data, off, SPACED, True), p.words)
                n = np.bincount(text, minlength=j - i)
                full = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64) if len(full) else np.zeros(0, np.int64)
                key = np.zeros((len(full), 2), dtype=np.uint64)
                sig = np.zeros((len(full), p.size), dtype=np.uint16)
                if len(full):
                    key[:, 0] = np.add.reduceat(mix64(h + np.uint64(7)), first)
                    key[:, 1] = np.add.reduceat(mix64(h ^ np.uint64(0x5DEECE66D)), first)
                    sig = _signatures(h, first, p)
                where = np.full(j - i, -1)
                where[full] = np.arange(len(full))
                take = pa.array(where, mask=where < 0)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), _binary_rows(key).take(take), _binary_rows(sig).take(take)], names=["node", "text_hash", "n_shingles", "set_key", "sig"])

    return run


def _bands(p: NearDedup):
    """A row (node, nth, band) for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _band_keys(_matrix(batch.column(1), np.uint16, p.size), p)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), p.bands)), pa.array(np.tile(np.arange(p.bands, dtype=np.int32), len(keys))), pa.array(keys.ravel())], names=["node", "nth", "band"])

    return run


def _prune(p: NearDedup):
    """Keep the pairs whose signatures don't rule the similarity out, after each batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column("sig_a"), np.uint16, p.size), _matrix(batch.column("sig_b"), np.uint16, p.size)
            left, agree = np.arange(len(x)), np.zeros(len(x), np.int64)
            for at in range(0, p.size, p.batch):
                agree = agree + (x[left, at : at + p.batch] == y[left, at : at + p.batch]).sum(1)
                stay = agree >= least_agreement(min(at + p.batch, p.size), p.percent, p.miss)
                left, agree = left[stay], agree[stay]
            yield batch.select(["a", "b"]).take(pa.array(left))

    return run


#: Bits of the filter that tells which texts to make sets of: 16 for each, as long as that is broadcast in 128 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30


def _filter_of(nodes: DataFrame, bits: int) -> np.ndarray:
    """A one-probe Bloom filter of node ids, as 64-bit words; what it lets through besides is dropped by the join with the nodes."""
    places = nodes.select(F.pmod(F.xxhash64("node"), F.lit(bits)).alias("place"))
    words = places.groupBy(F.expr("cast(place div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _hit(words: np.ndarray, place: np.ndarray) -> pa.Array:
    return pa.array((words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1)


def _sets(p: NearDedup, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(_hit(bits.value, batch.column(2).to_numpy()))
            for i, j, data, off in chunks(batch.column(1)):
                h, text = shingles(split_words(data, off, SPACED, True), p.words)
                edge = np.searchsorted(text, np.arange(j - i + 1)) * 8
                values = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), values.cast(pa.binary())], names=["node", "members"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two sorted sets share."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def _verify(p: NearDedup):
    """Keep the pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (s, t) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                common = _common(x, y)
                if 100 * common >= p.percent * (len(x) + len(y) - common):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _by_task(group):
    """Runs `group` on the rows of each task; rows come ordered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task = None
        for batch in batches:
            keys = batch.column("task").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                if held and keys[at] != task:
                    if (out := group(pa.Table.from_batches(held))) is not None:
                        yield from out.to_batches()
                    held = []
                task = keys[at]
                held.append(batch.slice(at, end - at))
        if held and (out := group(pa.Table.from_batches(held))) is not None:
            yield from out.to_batches()

    return run


def _block_survivors(rows: pa.Table, p: NearDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of different components that survive pruning, with the signature rows they agree on.

    A pair counts in the first band that it shares.
    """
    comp, side, size = (rows.column(c).to_numpy() for c in ("component", "side", "n_shingles"))
    sig = _matrix(rows.column("sig"), np.uint16, p.size)
    bands = _band_keys(sig, p)
    here, one = int(rows.column("nth")[0].as_py()), bool(rows.column("same")[0].as_py())
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    found = []
    for i in left:
        other = right[right > i] if one else right
        other = other[(comp[other] != comp[i]) & (100 * np.minimum(size[other], size[i]) >= p.percent * np.maximum(size[other], size[i]))]
        agree = np.zeros(len(other), np.int64)
        for at in range(0, p.size, p.batch):
            if not len(other):
                break
            agree = agree + (sig[other, at : at + p.batch] == sig[i, at : at + p.batch]).sum(1)
            stay = agree >= least_agreement(min(at + p.batch, p.size), p.percent, p.miss)
            other, agree = other[stay], agree[stay]
        if len(other):
            stay = ~(bands[other, :here] == bands[i, :here]).any(1)
            found.append((np.full(stay.sum(), i), other[stay], agree[stay]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _with_survivors(p: NearDedup):
    """Of each block pair, the members that have a survivor there."""

    def group(rows: pa.Table) -> pa.Table | None:
        x, y, _ = _block_survivors(rows, p)
        return rows.take(np.unique(np.concatenate([x, y]))) if len(x) else None

    return _by_task(group)


def _compare_blocks(p: NearDedup):
    """Links between different components within each block pair of a bucket.

    Survivors of pruning are verified here, those that agree most first, and a
    pair that verified links already connect is passed over; so what leaves a
    block pair is at most one link for each member.  Rows come ordered by task.
    """

    def group(rows: pa.Table) -> pa.Table | None:
        x, y, agree = _block_survivors(rows, p)
        if not len(x):
            return None
        node, comp, size = (rows.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("members").combine_chunks()]
        parent = {c: c for c in np.unique(comp).tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for k in np.argsort(-agree, kind="stable"):
            i, j = x[k], y[k]
            r, s = root(int(comp[i])), root(int(comp[j]))
            if r != s:
                common = _common(sets[i], sets[j])
                if 100 * common >= p.percent * (size[i] + size[j] - common):
                    parent[max(r, s)] = min(r, s)
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _by_task(group)


def _set_table(texts: DataFrame, nodes: DataFrame, p: NearDedup, scratch: Scratch, name: str) -> DataFrame:
    """Rows (node, members): shingle sets of at least the given nodes, made again from their texts; saved.

    A small filter picks the texts where they are read, so that they are never shuffled.
    """
    nodes = scratch.save(nodes, f"{name}-nodes")
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * nodes.count()).bit_length()))
    bits = texts.sparkSession.sparkContext.broadcast(_filter_of(nodes, size))
    place = F.pmod(F.xxhash64("node"), F.lit(size)).alias("place")
    return scratch.save(texts.where("node is not null").select("node", "text", place).mapInArrow(_sets(p, bits), "node long, members binary"), name)


def _star_links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """Of candidate pairs (a, b), those that are links; saved."""
    sig = reps.select("node", "sig")
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = scratch.save(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(p), "a long, b long"), "survivors")
    sets = _set_table(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), p, scratch, "star-sets")
    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a")
    return scratch.save(full.select("a", "b", "set_a", "set_b").mapInArrow(_verify(p), "a long, b long"), "star-links")


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, component_id, kept, class_id, component), one for each row of docs.

    component_id is the smallest id reachable over links, class_id the smallest
    id with an equal shingle set.  A null, empty or wordless text has no
    shingles and is linked with nothing.  Rows that repeat an id with different
    texts are linked by their own texts only, so that two components may have
    one component_id; component tells them apart.  A null id gives a null
    component.  text_hash is Spark's xxhash64 of the text.  Other columns of
    docs are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    every = scratch.save(texts.mapInArrow(_features(p), _FEATURES), "features")
    if every.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").isEmpty():
        return _linked(every, texts, p, scratch).withColumnRenamed("node", "doc_id").withColumn("component", F.col("component_id"))
    # ids that stand for several texts: rows are linked by numbers of their own
    texts = scratch.save(texts.withColumnRenamed("node", "doc_id").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    every = scratch.save(texts.select("node", "text_hash", "text").mapInArrow(_features(p), _FEATURES), "own-features")
    found = _linked(every, texts, p, scratch).drop("text_hash").join(texts.select("node", "doc_id", "text_hash"), "node")
    for name in ("component", "class"):
        least = found.groupBy(F.col(f"{name}_id").alias("number")).agg(F.min("doc_id").alias("least"))
        found = found.withColumnRenamed(f"{name}_id", "number").join(least, "number").withColumnRenamed("number", f"{name}_number").withColumnRenamed("least", f"{name}_id")
    found = found.unionByName(texts.where("node is null").join(every.where("node is null").select("text_hash", "n_shingles").distinct(), "text_hash").select("doc_id", "text_hash", "n_shingles"), allowMissingColumns=True)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "text_hash", "n_shingles", "component_id", kept.alias("kept"), "class_id", F.col("component_number").alias("component"))


def _linked(every: DataFrame, texts: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """Rows (node, text_hash, n_shingles, component_id, kept, class_id) of features, whose nodes have one text each."""
    classes = every.where("n_shingles > 0 and node is not null").groupBy("set_key").agg(F.min("node").alias("class_id"))
    first = every.where("n_shingles > 0").join(classes.withColumnRenamed("class_id", "node"), ["set_key", "node"], "left_semi").dropDuplicates(["set_key"])
    reps = scratch.save(first.select("node", "n_shingles", "sig"), "classes")
    banded = reps.select("node", "sig").mapInArrow(_bands(p), "node long, nth int, band long")
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = scratch.save(banded.join(buckets, "band").where("node <> least"), "members")
    star = members.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    edges = _star_links(star, reps, texts, p, scratch).select(F.col("a").alias("u"), F.col("b").alias("v"))
    component = scratch.save(connected_components(edges, scratch, "star-steps"), "star-components")
    apart = _apart_links(reps, members, component, texts, p, scratch)
    if not apart.isEmpty():
        joined = connected_components(apart, scratch, "apart-steps").withColumnRenamed("component", "whole")
        component = component.unionByName(apart.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(component, "node", "left_anti").select("node", F.col("node").alias("component")))
        component = scratch.save(component.join(joined, component.component == joined.node, "left").select(component.node, F.coalesce("whole", "component").alias("component")), "components")
    joined_to = component.select(F.col("node").alias("class_id"), "component")
    whole = F.coalesce("component", "class_id", "node")
    return (
        every.select("node", "text_hash", "n_shingles", "set_key")
        .join(classes, "set_key", "left")
        .join(joined_to, "class_id", "left")
        .select(
            "node",
            "text_hash",
            "n_shingles",
            F.when(F.col("node").isNotNull(), whole).alias("component_id"),
            F.coalesce(F.col("node") == whole, F.lit(False)).alias("kept"),
            F.when(F.col("node").isNotNull(), F.coalesce("class_id", "node")).alias("class_id"),
        )
    )


def _apart_links(reps: DataFrame, members: DataFrame, component: DataFrame, texts: DataFrame, p: NearDedup, scratch: Scratch) -> DataFrame:
    """Links (u, v) between components, from buckets that still hold several; saved.

    A bucket's least member has met all the others, so it stays out.  A bucket's
    rows are dealt to pairs of blocks, whose size is bounded in members and bytes.
    """
    members = members.where("n > 2").select("band", "nth", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = members.join(reps.select("node", "n_shingles"), "node")
    mixed = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), (8 * F.sum("n_shingles")).alias("bytes")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("size") / p.block), F.ceil(F.col("bytes") / p.block_bytes)).cast("int")
    rows = members.join(mixed.select("band", blocks.alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), j -> named_struct('lo', least(block, j), 'hi', greatest(block, j), 'side', if(block <= j, 0, 1), 'same', block = j))")
    rows = rows.select("band", "nth", "node", "n_shingles", "component", F.explode(pairs).alias("t"))
    rows = rows.select(F.xxhash64("band", "t.lo", "t.hi").alias("task"), "nth", "node", "n_shingles", "component", F.col("t.side").alias("side"), F.col("t.same").alias("same"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(reps.select("node", "sig"), "node").repartition(n, "task").sortWithinPartitions("task")
    schema = "node long, task long, nth int, n_shingles long, component long, side int, same boolean, sig binary"
    rows = scratch.save(dealt.select("node", "task", "nth", "n_shingles", "component", "side", "same", "sig").mapInArrow(_with_survivors(p), schema), "apart-survivors")
    sets = _set_table(texts, rows.select("node").distinct(), p, scratch, "apart-sets")
    dealt = rows.join(sets, "node").repartition(n, "task").sortWithinPartitions("task")
    found = scratch.save(dealt.mapInArrow(_compare_blocks(p), "a long, b long"), "apart-links")
    own = component.withColumnRenamed("component", "c")
    u = found.join(own.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a", "left").join(own.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b", "left")
    return scratch.save(u.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")), "apart-edges")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in components of 4-word shingle sets at similarity 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), NearDedup(words=4)).drop("text_hash", "component")
