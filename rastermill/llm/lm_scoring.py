"""Language-model scores from a log-frequency Bloom filter (after Talbot and Osborne).

Spark counts all training unigrams and bigrams.  Each n-gram enters a Bloom
filter once for every level of its count on a log scale, so its quantised count
is the number of levels that repeated probes find.  The filter has fixed bits
for each entry, so it grows with the counts and its rate of false hits is the
same at any size.  It is broadcast while it has at most `most_bytes`; beyond,
its segments stay a table, the n-grams of pieces of text are sent to their
segments, probed there, and their levels sent back.  Both ways give the same
scores.

Probabilities are Dirichlet-smoothed bigrams over add-one unigrams; all counts
in them come from the filter.  Exact unigram scores come beside it: the most frequent words are broadcast, in bounded
number, and the rest meet their counts in a shuffle.

N-grams travel as 64-bit hashes in packed arrays, one row for each segment of
the hash range, so that shuffles move few large rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from .words import SPACED, chunks, mix64, split_words

_U = np.uint64
END = mix64(np.array([0x656E64], np.uint64))[0]
#: Pairs of n-gram and count that a task gathers before it passes them on.
HELD = 2_000_000
#: Bytes of text whose n-grams are asked for together, and n-grams that a task gathers before it looks them up.
PIECE_BYTES, ASKED = 1 << 22, 1 << 20


@dataclass(frozen=True)
class Filter:
    """Parameters of the filter and of smoothing; a filter above most_bytes is probed in a shuffle instead of a broadcast.

    Words get at least bits_per_word for each entry: they are few, and a false
    hit on a common one would touch all that follows it.
    """

    bits_per_entry: int = 8
    bits_per_word: int = 24
    probes: int = 5
    most_bytes: int = 128 << 20
    most_frequent: int = 1 << 20
    prior: float = 50.0


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, the bigram hash that ends at each, and its text."""
    words = split_words(data, off, SPACED, True)
    n = len(words)
    text = np.repeat(np.arange(n), words.counts + 1)
    uni = np.full(len(words.hash) + n, END, np.uint64)
    uni[np.arange(len(words.hash)) + words.text_of()] = words.hash
    return uni, _bigrams(uni), text


def _bigrams(uni: np.ndarray) -> np.ndarray:
    before = np.empty_like(uni)
    before[:1], before[1:] = END, uni[:-1]
    return mix64(before * _U(0x9E3779B97F4A7C15) + uni * _U(0xC2B2AE3D27D4EB4F))


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _binary(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Binary values that hold values[edge[i] : edge[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


_PACKED = "kind int, segment int, keys binary, counts binary"


def _count(shift: int):
    """Packed counts of each kind (0: words, 1: bigrams) by segment, the hash's bits above shift."""

    def packed(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, n = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        segment = (keys >> _U(shift)).astype(np.int32)
        own = np.unique(segment)
        edge = np.append(np.searchsorted(segment, own), len(keys))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), _binary(keys, edge), _binary(n.astype(np.int64), edge)], names=["kind", "segment", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = 0
        for batch in batches:
            for _, _, data, off in chunks(batch.column(0)):
                uni, bi, _ = _tokens(data, off)
                for kind, keys in enumerate((uni, bi)):
                    keys, n = np.unique(keys, return_counts=True)
                    held[kind].append((keys, n))
                    size += len(keys)
                if size > HELD:
                    yield from (packed(k, parts) for k, parts in enumerate(held))
                    held, size = [[], []], 0
        if size:
            yield from (packed(k, parts) for k, parts in enumerate(held))

    return run


#: Levels of the count scale for each doubling.
OCTAVE = 2


def _levels(counts: np.ndarray) -> np.ndarray:
    """How many of _LEAST a count reaches, the number of filter entries of an n-gram."""
    return np.searchsorted(_LEAST, counts, side="right").astype(np.int64)


#: The least count of each level, and the mean of a level's least and largest count, for which it stands.
_LEAST = np.unique(np.ceil(2.0 ** (np.arange(40 * OCTAVE) / OCTAVE)).astype(np.int64))
_STANDS_FOR = np.concatenate([[0.0], (_LEAST + np.append(_LEAST[1:], 1 << 40) - 1) / 2])


def _bit_places(keys: np.ndarray, level: int, n_bits: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """Place of each probe's bit in its segment: the hash's high half, scaled to the segment."""
    h = mix64(keys + _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step = mix64(h) | _U(1)
    for k in range(probes):
        yield (((h + _U(k) * step) >> _U(32)) * n_bits) >> _U(32)


_MERGED = "kind int, segment int, keys binary, counts binary, total long, n long, histogram array<long>, bits long, filter binary"


def _merge(p: Filter):
    """Sums each segment's counts and builds its part of the filter; words keep their counts beside it."""

    def finish(kind: int, segment: int, parts: list) -> pa.RecordBatch:
        keys, n = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        level = _levels(n)
        bits = max(64, max(p.bits_per_entry, (1 - kind) * p.bits_per_word) * int(level.sum()))
        on = np.zeros(-(-bits // 8) * 8, np.uint8)
        for j in range(1, int(level.max()) + 1):
            for place in _bit_places(keys[level >= j], j, _U(bits), p.probes):
                on[place] = 1
        own = kind == 0
        return pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([kind], pa.int32()), "segment": pa.array([segment], pa.int32()), "keys": pa.array([keys.tobytes() if own else None], pa.binary()),
                "counts": pa.array([n.tobytes() if own else None], pa.binary()), "total": [int(n.sum())], "n": [len(keys)],
                "histogram": pa.array([np.bincount(level, minlength=len(_STANDS_FOR)).tolist() if own else []], pa.list_(pa.int64())), "bits": [bits], "filter": pa.array([np.packbits(on).tobytes()], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for batch in batches:
            for kind, segment, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if now != (kind, segment) and parts:
                    yield finish(*now, parts)
                    parts, size = [], 0
                now = (kind, segment)
                parts.append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)))
                size += len(parts[-1][0])
                if size > HELD and len(parts) > 1:  # what is held grows with different n-grams only
                    parts = [_sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
                    size = 0
        if parts:
            yield finish(*now, parts)

    return run


@dataclass
class CountFilter:
    """The filter's segments of words, then of bigrams, one after another; absent ones have no bits."""

    probes: int
    shift: int
    segments: int
    bits: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The highest level of each n-gram found by probing level after level."""
        at = (keys >> _U(self.shift)).astype(np.int64) + kind * self.segments
        return _probe(keys, self.bits[at], self.first[at], self.data, self.probes)


def _probe(keys: np.ndarray, bits: np.ndarray, first: np.ndarray, data: np.ndarray, probes: int) -> np.ndarray:
    """Levels of n-grams whose segments have so many bits from a byte of data on."""
    level = np.zeros(len(keys), np.uint8)
    left = np.flatnonzero(bits > 0)
    for j in range(1, len(_STANDS_FOR)):
        if not len(left):
            break
        found = np.ones(len(left), bool)
        for place in _bit_places(keys[left], j, bits[left], probes):
            place = place.astype(np.int64)
            found &= (data[first[left] + (place >> 3)] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        left = left[found]
        level[left] = j
    return level


@dataclass
class Frequent:
    """Exact counts of the most frequent words, sorted by hash, and of all training tokens."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are among them, and their counts."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        often = self.words[at] == words
        return often, np.where(often, self.counts[at], 0)


@dataclass
class Piece:
    """The tokens of some texts: distinct words and bigrams, sorted, where each token's are, and each token's text."""

    u: np.ndarray
    u_at: np.ndarray
    b: np.ndarray
    b_first: np.ndarray
    b_at: np.ndarray
    text: np.ndarray
    n: int

    @classmethod
    def of(cls, uni: np.ndarray, bi: np.ndarray, text: np.ndarray, n: int) -> Piece:
        u, u_at = np.unique(uni, return_inverse=True)
        b, b_first, b_at = np.unique(bi, return_index=True, return_inverse=True)
        return cls(u, u_at, b, b_first, b_at, text, n)

    def scores(self, u_level: np.ndarray, b_level: np.ndarray, total: int, distinct: int, prior: float) -> np.ndarray:
        """log10 probability of each text: words and bigrams count as their levels in the filter stand for."""
        c_u = _STANDS_FOR[u_level]
        p_u = (c_u + 1) / (total + distinct + 1)
        context = np.concatenate([[int(np.searchsorted(self.u, END))], self.u_at[:-1]])
        c_b = _STANDS_FOR[b_level]
        h = np.maximum(c_u[context[self.b_first]], c_b)
        log_b = np.log10((c_b + prior * p_u[self.u_at[self.b_first]]) / (h + prior))
        return np.bincount(self.text, log_b[self.b_at], self.n)


_SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare binary, times binary"


def _score(filter_, frequent, prior: float):
    """A row for each text; without a filter, score is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Frequent = frequent.value
        for batch in batches:
            for i, j, data, off in chunks(batch.column("text")):
                n = j - i
                uni, bi, text = _tokens(data, off)
                if filter_ is None:
                    u, u_at = np.unique(uni, return_inverse=True)
                    often, exact = f.find(u)
                    score = np.zeros(n)
                else:
                    p = Piece.of(uni, bi, text, n)
                    u, u_at = p.u, p.u_at
                    often, exact = f.find(u)
                    score = p.scores(filter_.value.levels(u, 0), filter_.value.levels(p.b, 1), f.total, f.distinct, prior)
                log_u = np.log10(exact + 1.0)
                logs, known = np.bincount(text, log_u[u_at], n), np.bincount(text[often[u_at]], minlength=n)
                seldom = ~often[u_at]
                key, where = uni[seldom], text[seldom]
                order = np.lexsort((key, where))
                key, where = key[order], where[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(key))).astype(np.uint32)
                edge = np.searchsorted(where[first], np.arange(n + 1))
                carried = [batch.column(c).slice(i, n) for c in ("row_id", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(np.bincount(text, minlength=n), pa.int64()), pa.array(known, pa.int64()), pa.array(logs), pa.array(score), _binary(key[first], edge), _binary(times, edge)], names=["row_id", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare", "times"])

    return run


_PIECES = "piece long, row_ids binary, words binary, at binary, tokens binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of runs of texts, packed: distinct words, where each token's is, and each text's number of tokens."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j, data, off in chunks(batch.column("text"), PIECE_BYTES):
            uni, _, text = _tokens(data, off)
            u, at = np.unique(uni, return_inverse=True)
            row_ids, tokens = batch.column("row_id").slice(i, j - i).to_numpy(), np.bincount(text, minlength=j - i).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"piece": pa.array([number], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("row_ids", row_ids), ("words", u), ("at", at.astype(np.uint32)), ("tokens", tokens))})
            number += 1


def _unpacked(row_ids, words, at, tokens) -> tuple[np.ndarray, Piece]:
    u, at, tokens = (np.frombuffer(x.as_buffer(), t) for x, t in ((words, np.uint64), (at, np.uint32), (tokens, np.uint32)))
    uni = u[at]
    return np.frombuffer(row_ids.as_buffer(), np.int64), Piece.of(uni, _bigrams(uni), np.repeat(np.arange(len(tokens)), tokens), len(tokens))


_ASKED = "kind int, segment int, side int, keys binary, bits long, piece long"


def _ask(shift: int):
    """The distinct words and bigrams of each piece by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, *packed in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                _, p = _unpacked(*packed)
                for kind, keys in enumerate((p.u, p.b)):
                    segment = (keys >> _U(shift)).astype(np.int32)
                    own = np.unique(segment)
                    n, edge = len(own), np.append(np.searchsorted(segment, own), len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(own), pa.array(np.ones(n, np.int32)), _binary(keys, edge), pa.nulls(n, pa.int64()), pa.array(np.full(n, piece, np.int64))], names=["kind", "segment", "side", "keys", "bits", "piece"])

    return run


def _answer(probes: int):
    """Levels of the asked n-grams; a segment's filter comes before what is asked of it.

    Questions of many pieces are looked up together: there are as many as pieces
    times segments, so the fewer steps each takes the better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits, data, held, size = None, 0, np.zeros(1, np.uint8), [], 0

        def answers() -> pa.RecordBatch:
            key, n = np.concatenate([k for _, k in held]), len(held)
            level = _probe(key, np.full(len(key), bits, np.uint64), np.zeros(len(key), np.int64), data, probes)
            edge = np.cumsum([0, *(len(k) for _, k in held)])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.array(np.full(n, now[0], np.int32)), pa.array(np.full(n, now[1], np.int32)), _binary(level, edge)], names=["piece", "kind", "segment", "levels"])

        for batch in batches:
            for kind, segment, side, keys, n_bits, piece in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), *(batch.column(c).to_pylist() for c in (4, 5)), strict=True):
                if held and (size > ASKED or (kind, segment) != now):
                    yield answers()
                    held, size = [], 0
                if (kind, segment) != now:
                    now, bits, data = (kind, segment), 0, np.zeros(1, np.uint8)
                if side == 0:
                    bits, data = n_bits, np.frombuffer(keys.as_buffer(), np.uint8)
                    continue
                held.append((piece, np.frombuffer(keys.as_buffer(), np.uint64)))
                size += len(held[-1][1])
        if held:
            yield answers()

    return run


def _assemble(frequent, prior: float):
    """Scores of a piece's texts from its answers, which come after it in the order of their n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Frequent = frequent.value
        rows, p, levels = None, None, [[], []]

        def done() -> pa.RecordBatch:
            score = p.scores(*(np.concatenate(x) for x in levels), f.total, f.distinct, prior)
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(score)], names=["row_id", "score"])

        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for k, kind in enumerate(kinds):
                if kind < 0:
                    if p is not None:
                        yield done()
                    rows, p = _unpacked(*(batch.column(c)[k] for c in ("row_ids", "words", "at", "tokens")))
                    levels = [[], []]
                else:
                    levels[kind].append(np.frombuffer(batch.column("levels")[k].as_buffer(), np.uint8))
        if p is not None:
            yield done()

    return run


def _scores_by_shuffle(texts: DataFrame, merged: DataFrame, frequent, p: Filter, shift: int, n: int, scratch: Scratch) -> DataFrame:
    """Rows (row_id, score): n-grams of pieces of text meet their filter segment, and their levels the piece, in shuffles."""
    pieces = scratch.save(texts.select("row_id", "text").mapInArrow(_pieces, _PIECES), "pieces")
    filters = merged.select("kind", "segment", F.lit(0).alias("side"), F.col("filter").alias("keys"), "bits", F.lit(None).cast("long").alias("piece"))
    both = filters.unionByName(pieces.mapInArrow(_ask(shift), _ASKED))
    levels = both.repartition(n, "kind", "segment").sortWithinPartitions("kind", "segment", "side").mapInArrow(_answer(p.probes), "piece long, kind int, segment int, levels binary")
    whole = pieces.withColumns({"kind": F.lit(-1), "segment": F.lit(-1)}).unionByName(levels, allowMissingColumns=True)
    whole = whole.repartition(n, "piece").sortWithinPartitions("piece", "kind", "segment").select("kind", "row_ids", "words", "at", "tokens", "levels")
    return whole.mapInArrow(_assemble(frequent, p.prior), "row_id long, score double")


def _deal_rare(shift: int):
    """Rare words of a batch of documents by segment: keys, times and row ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 10_000):
                some = batch.slice(at, 10_000)
                keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in some.column(1)]
                row = np.repeat(some.column(0).to_numpy(), [len(k) for k in keys])
                key, times = np.concatenate(keys), np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in some.column(2)])
                order = np.argsort(key)
                key, row, times = key[order], row[order], times[order]
                segment = (key >> _U(shift)).astype(np.int32)
                own = np.unique(segment)
                edge = np.append(np.searchsorted(segment, own), len(key))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.ones(len(own), np.int32)), _binary(key, edge), _binary(times, edge), _binary(row, edge)], names=["segment", "side", "keys", "counts", "row_ids"])

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each row of the rare words it has in a segment; the segment's counts come first."""
    now, words, counts, held, size = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def sums() -> pa.RecordBatch:
        key, times, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        c = np.zeros(len(key), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, key), len(words) - 1)
            c = np.where(words[at] == key, counts[at], 0)
        row, where = np.unique(rows, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.bincount(where, times * np.log10(c + 1.0))), pa.array(np.bincount(where, times * (c > 0)).astype(np.int64))], names=["row_id", "more_logs", "more_known"])

    for batch in batches:
        for segment, side, keys, second, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4), strict=True):
            if held and (size > ASKED or segment != now):
                yield sums()
                held, size = [], 0
            if segment != now:
                now, words, counts = segment, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if side == 0:
                words, counts = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(second.as_buffer(), np.int64)
                continue
            held.append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(second.as_buffer(), np.uint32), np.frombuffer(rows.as_buffer(), np.int64)))
            size += len(held[-1][0])
    if held:
        yield sums()


def _whole_filter(merged: DataFrame, probes: int, shift: int, segments: int) -> CountFilter:
    held = merged.select("kind", "segment", "bits", "filter").toArrow()  # within the bound on what is broadcast
    at = held.column("kind").to_numpy() * segments + held.column("segment").to_numpy()
    bits, first = np.zeros(2 * segments, np.uint64), np.zeros(2 * segments, np.int64)
    blobs = [np.frombuffer(x.as_buffer(), np.uint8) for x in held.column("filter")]
    bits[at] = held.column("bits").to_numpy().astype(np.uint64)
    first[at] = np.cumsum([0, *map(len, blobs)])[:-1]
    return CountFilter(probes, shift, segments, bits, first, np.concatenate([*blobs, np.zeros(1, np.uint8)]))


def score_documents(docs: DataFrame, held_out, p: Filter = Filter(), scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs.

    held_out is a boolean column over docs: rows where it is true are only
    scored, all others also train.  base_score is the exact add-one unigram
    log10 probability, score the model's.  A null or empty text is its end
    token alone; repeated rows and null ids count and are scored one by one;
    without training rows all counts are 0; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(4, (int(size) >> 22).bit_length()))  # segments of a few MB of text, 65536 at most
    shift, segments = 64 - bits, 1 << bits
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.where("not held_out").select("text").mapInArrow(_count(shift), _PACKED)
    merged = scratch.save(packed.repartition(n, "kind", "segment").sortWithinPartitions("kind", "segment").mapInArrow(_merge(p), _MERGED), "counts")
    words = merged.where("kind = 0")
    total, distinct = (x or 0 for x in words.agg(F.sum("total"), F.sum("n")).first())
    # the lowest level from which on there are few enough words to broadcast
    by_level = dict(words.select(F.posexplode("histogram")).groupBy("pos").agg(F.sum("col")).collect())
    above, level = 0, len(_LEAST)
    while level > 0 and above + by_level.get(level, 0) <= p.most_frequent:
        above, level = above + by_level.get(level, 0), level - 1
    least = int(_LEAST[level]) if level < len(_LEAST) else 1 << 62

    def frequent_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
                some = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some])], names=["key", "n"])

    often = words.select("keys", "counts").mapInArrow(frequent_only, "key long, n long").toArrow()  # at most p.most_frequent rows
    keys = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast(Frequent(keys[order], often.column("n").to_numpy()[order], total, distinct))
    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    if (merged.agg(F.sum("bits")).first()[0] or 0) <= 8 * p.most_bytes:
        filter_ = spark.sparkContext.broadcast(_whole_filter(merged, p.probes, shift, segments))
        scored = scratch.save(numbered.mapInArrow(_score(filter_, frequent, p.prior), _SCORED), "scored")
    else:
        numbered = scratch.save(numbered, "numbered")  # the numbers must stay the same
        scored = scratch.save(numbered.mapInArrow(_score(None, frequent, p.prior), _SCORED), "scored")
        scores = _scores_by_shuffle(numbered, merged, frequent, p, shift, n, scratch)
        scored = scratch.save(scored.drop("score").join(scores, "row_id"), "rescored")
    rare = scored.select("row_id", "rare", "times").where(F.length("rare") > 0).mapInArrow(_deal_rare(shift), "segment int, side int, keys binary, counts binary, row_ids binary")
    both = merged.where("kind = 0").select("segment", F.lit(0).alias("side"), "keys", "counts", F.lit(None).cast("binary").alias("row_ids")).unionByName(rare)
    found = both.repartition(n, "segment").sortWithinPartitions("segment", "side").mapInArrow(_look_up, "row_id long, more_logs double, more_known long")
    more = found.groupBy("row_id").agg(F.sum("more_logs").alias("more_logs"), F.sum("more_known").alias("more_known"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return scored.drop("rare", "times").join(more, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), logs.alias("base_score"), "score"
    )


def op6_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, scored by a model of those whose id's crc32 leaves no remainder 2 by 7."""
    return score_documents(read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
