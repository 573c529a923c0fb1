"""Exact Jaccard self-join of word-shingle sets that skips by relations between sets.

Equal sets are one class.  Two relations spare work on the rest:

* Of each set only a prefix, rarest shingles first, is in the index lists.  A
  list holds blocks (group, size, position).  Where a shingle stands in a set
  bounds what two sets share from there on, so a probe reads, of a list's
  blocks of one size, those up to a position, and skips all behind it.
* Highly similar sets form a group around a leader, found by a small sketch.
  Within and between groups answers follow from the leader's: with L the
  leader, x = L - x1 + x2 and z = L - z1 + z2, what x and z share is
  |L| - |x1| - |z1| + |x1 & z1| + |x2 & z2|.  Only the differences are compared,
  and members within half the distance bound of their leader are linked to one
  another without a comparison (the Jaccard distance is a metric).

The order of shingles and the groups decide only what the join costs; links are
exact whatever they are.  Lists and groups are dealt to tasks in pairs of
blocks, and a task gives each of its nodes one row: the number of its links
there and the least node it reaches there.  No group's pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from ..operators.graph import connected_components
from .near_dedup import NearDedup, _binary_rows, _by_task, _permutations, _set_table
from .words import SPACED, chunks, mix64, shingles, split_words


@dataclass(frozen=True)
class JaccardJoin:
    """percent: least similarity; counters: places of shingle counts, which only order shingles; sketch, agree: values of a sketch, and how many of them a member shares with its leader."""

    words: int = 5
    percent: int = 80
    counters: int = 1 << 20
    sketch: int = 8
    agree: int = 4
    block: int = 1024
    block_bytes: int = 1 << 24


#: Parts in which the counts of shingles travel.
_PARTS = 64
#: Pairs of blocks that a task holds at once.
_PAIRS = 1 << 21


def least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common members with which sets of n and m members reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of first[i], first[i] + 1, ... (count[i] of them), and the i of each."""
    of = np.repeat(np.arange(len(count)), count)
    return first[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of], of


def _features(p: JaccardJoin):
    """A row (node, text_hash, n_shingles, set_key) for each text; then the task's counts of shingles by place, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.counters, np.uint32)
        names = ["node", "text_hash", "n_shingles", "set_key", "part", "counts"]
        for batch in batches:
            for i, j, data, off in chunks(batch.column(2)):
                h, text = shingles(split_words(data, off, SPACED, True), p.words)
                total += np.bincount((h & np.uint64(p.counters - 1)).astype(np.int64), minlength=p.counters).astype(np.uint32)
                n = np.bincount(text, minlength=j - i)
                full = np.flatnonzero(n)
                key = np.zeros((j - i, 2), dtype=np.uint64)
                if len(full):
                    first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    key[full, 0] = np.add.reduceat(mix64(h + np.uint64(7)), first)
                    key[full, 1] = np.add.reduceat(mix64(h ^ np.uint64(0x5DEECE66D)), first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), _binary_rows(key), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=names)
        parts = np.arange(_PARTS, dtype=np.int32)
        none = [pa.nulls(_PARTS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(parts), _binary_rows(total.reshape(_PARTS, -1))], names=names)

    return run


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
            total[part] = np.minimum(total[part] + more, np.uint64(0xFFFFFFFF)) if part in total else more
    for part, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])


def _prefixes(p: JaccardJoin, counters):
    """A row (node, n_shingles, sketch, prefix) for each set: least values under a few hashes, and the shingles that come first in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(p.sketch)
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                h, text = shingles(split_words(data, off, SPACED, True), p.words)
                n = np.bincount(text, minlength=j - i)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                sketch = np.stack([np.minimum.reduceat(mix64(h * a[k] + b[k]), first) for k in range(p.sketch)], 1)
                count = counters.value[(h & np.uint64(p.counters - 1)).astype(np.int64)]
                h = h[np.lexsort((h, count, text))]
                long = n[full] - -(-p.percent * n[full] // 100) + 1
                at, _ = _ranges(first, long)
                edge = np.concatenate([[0], np.cumsum(long)]) * 8
                prefix = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(h[at].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(full)), pa.array(n[full]), _binary_rows(sketch), prefix], names=["node", "n_shingles", "sketch", "prefix"])

    return run


def _sketch_rows(p: JaccardJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), p.sketch)), pa.array(np.tile(np.arange(p.sketch, dtype=np.int32), len(batch))), pa.array(values)], names=["node", "nth", "value"])

    return run


def _entries(bits, width: int):
    """A row (token, node, size, position) for each shingle of a prefix; with bits, only shingles that hit the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("prefix")
            long = np.array([len(x.as_buffer()) // 8 for x in column], np.int64)
            token = np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint64)
            at, of = _ranges(np.zeros(len(long), np.int64), long)
            if bits is not None:
                place = token & np.uint64(width - 1)
                hit = (bits.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                token, at, of = token[hit], at[hit], of[hit]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(batch.column("node").to_numpy()[of]), pa.array(batch.column("n_shingles").to_numpy()[of]), pa.array(at)], names=["token", "node", "size", "position"])

    return run


_ENTRY = "token long, node long, size long, position long"


def _token_filter(tokens: DataFrame, width: int) -> np.ndarray:
    """A bit for each value of the tokens' low bits that occurs, as 64-bit words."""
    place = tokens.select(F.col("token").bitwiseAND(width - 1).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(width // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


#: Bits of that filter: 16 for each token, as long as it is broadcast in 128 MB; what it lets through besides, a join drops.
_LEAST_BITS, _MOST_BITS = 1 << 16, 1 << 30


def _group_pairs(p: JaccardJoin):
    """Rows (a, b): groups that may hold linked sets, from index lists; rows come ordered by task, size and position.

    A list's blocks of one size are read up to the last position at which a
    shingle can stand in such a set if the two are to be linked.
    """

    def group(rows: pa.Table) -> pa.Table | None:
        grp, size, pos, side = (rows.column(c).to_numpy() for c in ("grp", "size", "position", "side"))
        apart = not rows.column("same")[0].as_py()
        edge = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]]))
        sizes, ends = size[edge], np.concatenate([edge[1:], [len(size)]])
        key = np.searchsorted(sizes, size) * (1 << 40) + pos
        low = np.searchsorted(sizes, -(-p.percent * size // 100))  # sizes from there up to its own
        found = []
        step = max(1, _PAIRS // max(len(size), 1))
        for at in range(0, len(size), step):
            mine = np.arange(at, min(at + step, len(size)))
            block, of = _ranges(low[mine], np.searchsorted(sizes, size[mine], side="right") - low[mine])
            probe = mine[of]
            need = least_common(size[probe], sizes[block], p.percent)
            may = size[probe] - pos[probe] >= need
            probe, block, need = probe[may], block[may], need[may]
            last = np.searchsorted(key, block * (1 << 40) + np.maximum(sizes[block] - need + 1, 0))
            entry, of = _ranges(edge[block], np.clip(last, edge[block], ends[block]) - edge[block])
            probe = probe[of]
            stay = grp[probe] != grp[entry]
            if apart:
                stay &= side[probe] != side[entry]
            x, y = grp[probe[stay]], grp[entry[stay]]
            if len(x):
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))
        if not found:
            return None
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.table({"a": a, "b": b})

    return _by_task(group)


_MARKS = "grp long, low long, high long, marks binary"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (grp, low, high, marks) for each prefix: its shingles' last 16 bits, ordered."""
    for batch in batches:
        marks = [np.sort(np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint16)).tobytes() for x in batch.column("prefix")]
        size = batch.column("n_shingles")
        yield pa.RecordBatch.from_arrays([batch.column("grp"), size, size, pa.array(marks, pa.binary())], names=["grp", "low", "high", "marks"])


def _single_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (grp, low, high, mark) for each different mark of a prefix."""
    for batch in batches:
        marks = [np.unique(np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint16)) for x in batch.column("prefix")]
        of = np.repeat(np.arange(len(marks)), [len(x) for x in marks])
        size = batch.column("n_shingles").to_numpy()[of]
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("grp").to_numpy()[of]), pa.array(size), pa.array(size), pa.array(np.concatenate([*marks, np.zeros(0, np.uint16)]).astype(np.int32))], names=["grp", "low", "high", "mark"])


def _may_link(p: JaccardJoin):
    """The pairs of groups whose prefixes share enough for a link.

    Of two sets, the one whose prefix ends first in the order shares with the
    other at most what the prefixes share and all that follows its own prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low_a, high_a, low_b, high_b = (batch.column(c).to_numpy() for c in ("low_a", "high_a", "low_b", "high_b"))
            rest = np.maximum(-(-p.percent * high_a // 100), -(-p.percent * high_b // 100)) - 1
            need = least_common(low_a, low_b, p.percent) - rest
            keep = []
            for k, (a, b, one_a, one_b) in enumerate(zip(batch.column("marks_a"), batch.column("marks_b"), batch.column("one_a").to_pylist(), batch.column("one_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(b.as_buffer(), np.uint16)
                # a group's marks have lost how often they occur, so only a single set's are counted
                if not (one_a and len(x) - len(_without(x, y)) < need[k] or one_b and len(y) - len(_without(y, x)) < need[k]):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _without(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Members of x that aren't in y; both sorted."""
    if not len(y):
        return x
    return x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x]


_DELTA = "hub long, node long, own boolean, size long, copies long, least long, missing long, linked boolean, tight boolean, delta binary"


def _deltas(p: JaccardJoin):
    """Each node's answer for its leader, and, where others need it, what its set lacks and has besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for leader, own, more in zip(batch.column("leader_set"), batch.column("own_set"), batch.column("more").to_pylist(), strict=True):
                x, y = np.frombuffer(leader.as_buffer(), np.uint64), np.frombuffer(own.as_buffer(), np.uint64)
                lacks, besides = _without(x, y), _without(y, x)
                common, union = len(x) - len(lacks), len(x) + len(besides)
                rows.append((len(x), len(lacks), 100 * common >= p.percent * union, 200 * (union - common) <= (100 - p.percent) * union, np.sort(np.concatenate([lacks, besides])).tobytes() if more else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("hub", "node", "own", "size", "copies")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in _DELTA.split(", ")])

    return run


def _compare(p: JaccardJoin):
    """Rows (node, links, least): for a task's linked nodes the copies they are linked to there, and the least node of their local component; rows come ordered by task."""

    def group(rows: pa.Table) -> pa.Table | None:
        node, side, own, tight, size, copies, least, missing = (rows.column(c).to_numpy() for c in ("node", "side", "own", "tight", "size", "copies", "least", "missing"))
        deltas = [np.frombuffer(v.as_buffer(), np.uint64) for c in rows.column("delta").chunks for v in c]
        index, probes = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(index) or not len(probes):
            return None
        token = np.concatenate([deltas[z] for z in index])
        owner = np.repeat(np.arange(len(index)), [len(deltas[z]) for z in index])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        links, found = np.zeros(len(node), np.int64), []
        for x in probes:
            first = np.searchsorted(token, deltas[x])
            at, _ = _ranges(first, np.searchsorted(token, deltas[x], side="right") - first)
            common = least[x] - missing[x] - missing[index] + np.bincount(owner[at], minlength=len(index))
            z = index[(100 * common >= p.percent * (size[x] + size[index] - common)) & (node[index] != node[x])]
            if len(z):
                links[x] += copies[z].sum()
                links[z[tight[z]] if own[x] else z] += copies[x]  # loose members of the group count when they probe
                found.append((np.full(len(z), x), z))
        if not found:
            return None
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        names, number = np.unique(node, return_inverse=True)
        a, b, root = number[a], number[b], np.arange(len(names))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            for end in (root[a], root[b]):
                np.minimum.at(root, end, low)
            while (root != root[root]).any():
                root = root[root]
        total = np.bincount(number, links, minlength=len(names)).astype(np.int64)
        some = np.union1d(a, b)
        return pa.table({"node": names[some], "links": total[some], "least": names[root[some]]})

    return _by_task(group)


def _leaders(reps: DataFrame, p: JaccardJoin, scratch: Scratch) -> DataFrame:
    """Rows (node, grp): classes that share enough of a sketch with the least class of a bucket, which is in no other's group; saved."""
    values = scratch.save(reps.select("node", "sketch").mapInArrow(_sketch_rows(p), "node long, nth int, value long"), "sketches")
    buckets = values.groupBy("nth", "value").agg(F.min("node").alias("grp"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = values.join(buckets, ["nth", "value"]).where("node <> grp").groupBy("node", "grp").agg(F.count("*").alias("n"))
    chosen = scratch.save(met.where(F.col("n") >= p.agree).groupBy("node").agg(F.min("grp").alias("grp")), "chosen")
    return scratch.save(chosen.join(chosen.select(F.col("node").alias("grp")), "grp", "left_anti").select("node", "grp"), "members")


def _candidates(reps: DataFrame, members: DataFrame, p: JaccardJoin, scratch: Scratch) -> DataFrame:
    """Rows (a, b), a < b: different groups some of whose sets may be linked; saved."""
    every = reps.select("node", "n_shingles", "prefix")
    tokens = scratch.save(every.mapInArrow(_entries(None, 0), _ENTRY).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "repeated")
    width = min(_MOST_BITS, max(_LEAST_BITS, 1 << (16 * tokens.count()).bit_length()))
    bits = every.sparkSession.sparkContext.broadcast(_token_filter(tokens, width))
    live = every.mapInArrow(_entries(bits, width), _ENTRY).join(tokens, "token", "left_semi").join(members, "node", "left")
    blocks = scratch.save(live.select("token", F.coalesce("grp", "node").alias("grp"), "size", "position").distinct(), "blocks")
    lists = blocks.groupBy("token").agg(F.count("*").alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi")
    rows = blocks.join(lists.select("token", F.ceil(F.col("n") / p.block).cast("int").alias("_blocks")), "token").withColumn("_block", F.pmod(F.xxhash64("grp", "size", "position"), F.col("_blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, _blocks - 1), j -> named_struct('lo', least(_block, j), 'hi', greatest(_block, j), 'side', if(_block <= j, 0, 1), 'same', _block = j))")
    rows = rows.select("token", "grp", "size", "position", F.explode(pairs).alias("t"))
    rows = rows.select(F.xxhash64("token", "t.lo", "t.hi").alias("task"), "grp", "size", "position", F.col("t.side").alias("side"), F.col("t.same").alias("same"))
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "size", "position")
    return _pruned(scratch.save(dealt.mapInArrow(_group_pairs(p), "a long, b long").distinct(), "group-pairs"), reps, members, p, scratch)


def _pruned(pairs: DataFrame, reps: DataFrame, members: DataFrame, p: JaccardJoin, scratch: Scratch) -> DataFrame:
    """Pairs without those that the marks of their prefixes rule out; a group has at most 65536 different ones; saved."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("grp")).distinct()
    every = reps.select("node", "n_shingles", "prefix").join(members, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    groups = members.select("grp").distinct()
    every = scratch.save(every.join(wanted, "grp", "left_semi").select("grp", "n_shingles", "prefix"), "met-prefixes")
    one = every.join(groups, "grp", "left_anti").mapInArrow(_marks, _MARKS).withColumn("one", F.lit(True))
    of = every.join(groups, "grp", "left_semi").mapInArrow(_single_marks, "grp long, low long, high long, mark int").groupBy("grp", "mark").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("mark")), lambda m: F.concat(F.lpad(F.hex(m.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(m, 8)), 2, "0"))), "")
    many = of.groupBy("grp").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.unhex(text).alias("marks")).withColumn("one", F.lit(False))
    marked = scratch.save(one.unionByName(many), "marks")
    a, b = (marked.select(F.col("grp").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("low", "high", "marks", "one")]) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return scratch.save(both.select("a", "b", *[f"{c}_{x}" for c in ("low", "high", "marks", "one") for x in "ab"]).mapInArrow(_may_link(p), "a long, b long"), "may-link")


def _links(reps: DataFrame, members: DataFrame, pairs: DataFrame, texts: DataFrame, p: JaccardJoin, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (node, links) and edges (u, v) over all linked classes; links counts copies."""
    every = reps.select("node", F.col("n_shingles").alias("size"), "copies").join(members, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    sizes = every.groupBy("grp").agg(F.count("*").alias("n"))
    a, b = sizes.select(F.col("grp").alias("a"), F.col("n").alias("na")), sizes.select(F.col("grp").alias("b"), F.col("n").alias("nb"))
    # the larger group's leader is the hub of a pair, and the other group's members come to it
    larger = F.col("na") >= F.col("nb")
    hubs = pairs.join(a, "a").join(b, "b").select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("grp"))
    foreign = hubs.join(every, "grp").select("hub", "node", F.lit(False).alias("own"), "size", "copies")
    own = every.where("node <> grp").select(F.col("grp").alias("hub"), "node", F.lit(True).alias("own"), "size", "copies")
    rows = foreign.unionByName(own).join(sizes.select(F.col("grp").alias("hub"), (F.col("n") > 1).alias("more")), "hub")
    rows = scratch.save(rows, "to-hubs")
    sets = _set_table(texts, rows.select(F.explode(F.array("hub", "node")).alias("node")).distinct(), NearDedup(words=p.words), scratch, "sets")
    met = rows.join(sets.select("node", F.col("members").alias("own_set")), "node").join(sets.select(F.col("node").alias("hub"), F.col("members").alias("leader_set")), "hub")
    deltas = scratch.save(met.select("hub", "node", "own", "size", "copies", "more", "leader_set", "own_set").mapInArrow(_deltas(p), _DELTA), "deltas")

    stars = deltas.where("linked")
    own_copies = reps.select(F.col("node").alias("hub"), F.col("copies").alias("hub_copies"))
    counted = [stars.join(own_copies, "hub").select("node", F.col("hub_copies").alias("links")), stars.select(F.col("hub").alias("node"), F.col("copies").alias("links"))]
    # tight members of a group are linked to one another
    tight = deltas.where("own and tight")
    counted.append(tight.join(tight.groupBy("hub").agg(F.sum("copies").alias("total")), "hub").select("node", (F.col("total") - F.col("copies")).alias("links")))

    rest = deltas.where("delta is not null")
    probes, index = rest.where("not own or not tight"), rest.where("own")
    of = lambda x, i: x.groupBy("hub").agg(F.count("*").alias("n"), F.sum(F.length("delta")).alias("bytes")).select("hub", F.greatest(F.ceil(F.col("n") / p.block), F.ceil(F.col("bytes") / p.block_bytes)).cast("int").alias(i))
    blocks = of(probes, "p").join(of(index, "i"), "hub")
    dealt = None
    for x, mine, others, side in ((probes, "p", "i", 0), (index, "i", "p", 1)):
        one = x.join(blocks, "hub").withColumn("mine", F.pmod(F.xxhash64("node"), F.col(mine)).cast("int")).withColumn("other", F.explode(F.expr(f"sequence(0, {others} - 1)")))
        task = F.xxhash64("hub", "mine", "other") if side == 0 else F.xxhash64("hub", "other", "mine")
        one = one.select(task.alias("task"), F.lit(side).alias("side"), "node", "own", "tight", "size", "copies", "least", "missing", "delta")
        dealt = one if dealt is None else dealt.unionByName(one)
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task")
    found = scratch.save(dealt.mapInArrow(_compare(p), "node long, links long, least long"), "compared")
    counted.append(found.select("node", "links"))
    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    edges = stars.select(F.col("hub").alias("u"), F.col("node").alias("v")).unionByName(found.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    return every.groupBy("node").agg(F.sum("links").alias("links")), edges


def jaccard_join(docs: DataFrame, p: JaccardJoin = JaccardJoin(), scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id, n_links), one for each row of docs.

    Two rows link when their shingle sets reach the similarity.  n_links counts
    the other rows that a row links with, component_id is the smallest id
    reachable over links, class_id the smallest id with an equal set.  A null,
    empty or wordless text has no shingles and links with nothing.  Rows that
    repeat an id are rows of their own, each linked by its own text.  A row
    without an id is left out of all links and has null component, class and
    n_links.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard-join")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "node long, text_hash long, n_shingles long, set_key binary, part int, counts binary"
    first = scratch.save(texts.mapInArrow(_features(p), schema), "features")
    parts = first.where("part is not null").select("part", "counts").repartition("part").mapInArrow(_sum_parts, "part int, counts binary").toArrow()
    counts = np.zeros((_PARTS, p.counters // _PARTS), np.uint32)
    for part, values in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        counts[part] = np.frombuffer(values, np.uint32)
    counters = spark.sparkContext.broadcast(counts.ravel())
    every = first.where("part is null").drop("part", "counts")
    if every.where("node is not null").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _joined(every, texts, counters, p, scratch).select(F.col("node").alias("doc_id"), "n_shingles", "component_id", "class_id", "n_links")
    # ids that stand for several rows: rows are linked by numbers of their own
    texts = scratch.save(texts.withColumnRenamed("node", "doc_id").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    every = scratch.save(texts.select("node", "text_hash", "text").mapInArrow(_features(p), schema), "own-features").where("part is null").drop("part", "counts")
    found = scratch.save(_joined(every, texts, counters, p, scratch).join(texts.select("node", "doc_id"), "node"), "by-number")
    for name in ("component", "class"):
        least = found.groupBy(F.col(f"{name}_id").alias("_number")).agg(F.min("doc_id").alias("_least"))
        found = found.withColumnRenamed(f"{name}_id", "_number").join(least, "_number").drop("_number").withColumnRenamed("_least", f"{name}_id")
    alone = every.where("node is null").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles")
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links").unionByName(alone, allowMissingColumns=True)


def _joined(every: DataFrame, texts: DataFrame, counters, p: JaccardJoin, scratch: Scratch) -> DataFrame:
    """Rows (node, n_shingles, component_id, class_id, n_links) of features, whose nodes have one row each."""
    classes = scratch.save(every.where("n_shingles > 0 and node is not null").groupBy("set_key").agg(F.min("node").alias("class_id"), F.count("*").alias("copies")), "classes")
    rows = texts.where("node is not null").select("node", "text").mapInArrow(_prefixes(p, counters), "node long, n_shingles long, sketch binary, prefix binary")
    reps = scratch.save(rows.join(classes.select(F.col("class_id").alias("node"), "copies"), "node"), "prefixes")
    members = _leaders(reps, p, scratch)
    links, edges = _links(reps, members, _candidates(reps, members, p, scratch), texts, p, scratch)
    component = connected_components(edges, scratch, "components").withColumnRenamed("node", "class_id")
    of = classes.join(links.withColumnRenamed("node", "class_id"), "class_id", "left").join(component, "class_id", "left")
    of = scratch.save(of.select("set_key", "class_id", F.coalesce("component", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "found")
    own = F.when(F.col("node").isNotNull(), 0).cast("long")
    return every.select("node", "n_shingles", F.when(F.col("node").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key")).join(of, "set_key", "left").select(
        "node", "n_shingles", F.coalesce("component_id", "node").alias("component_id"), F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", own).alias("n_links")
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` joined by 5-word shingle sets at similarity 0.8."""
    return jaccard_join(read_table(spark, sf_dir, "documents"))
