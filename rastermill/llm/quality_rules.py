"""Quality rules: simple counts, and perplexity bands of a modified Kneser-Ney model for each language.

The model runs over symbols, the code points of the text, in n-grams of four.
Spark counts them and works out their discounts, contexts and interpolated
probabilities; the result is one sorted hash array that holds, for each n-gram
of every order, its probability and the mass it leaves as a context.  It is
broadcast while it has at most MOST_GRAMS n-grams; a larger one stays a table of
segments, to which the n-grams of pieces of text are sent.  A text's
probability is half its language's and half that of a model of all languages,
so that passages in another language don't count as noise.

Only texts that pass the base rules and read like prose train, each group of
equal or nearly equal ones once, and each half of them is judged by the model
of the other half, so that no text vouches for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from .words import SPACED, chunks, marked, mix64, ngram_hashes, split_words

_U = np.uint64
#: Bits a symbol: no language's robust deviation counts as less, so that a group of near copies can't close its band.
LEAST_SPREAD = 0.015
#: Symbols at which a text's deviation counts for about 0.7 of that of a long one.
SHORT = 1000
#: Shares of a prose text's word characters that are ASCII punctuation and capitals at most.
MOST_PUNCTUATION, MOST_CAPITALS = 0.1, 0.2
#: Marks before a text's first symbol and after its last, and what a NUL counts as.
BEFORE, AFTER, NUL = "\x02", "\x03", "\x01"
#: The chance of a symbol that was never seen: one of all code points.
UNSEEN = 1 / 0x110000
#: N-grams of a model that is broadcast, 16 bytes each, and bits of the segments of one that isn't.
MOST_GRAMS, SEGMENT_BITS = 1 << 24, 12
#: Languages whose bands are broadcast at most.
FEW = 100_000
#: Bands of a text by which it is found nearly equal to others, and the least hashes that make up each.
BANDS, ROWS = 3, 6
#: N-grams that a task gathers before it passes them on.
HELD = 400_000

_SYMBOL_BYTES = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_CAPITALS = np.array([65 <= b <= 90 for b in range(256)])


def _per_text(which: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked; off as in `chunks`."""
    out, full = np.zeros(len(off) - 1, np.int64), np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(which.view(np.uint8), off[full], dtype=np.int64)
    return out


def _dup_lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier one."""
    out, raw, edge = np.zeros(len(off) - 1, np.int64), data.tobytes(), off.tolist()
    for t in np.flatnonzero(_per_text(data == 10, off)).tolist():
        lines = [x for x in raw[edge[t] : edge[t + 1]].split(b"\n") if x and not x.isspace()]
        out[t] = len(lines) - len(set(lines))
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each group of equal keys is, and the number of each key's group.

    Each key writes its place into a slot, and those that find an equal key there
    are done; keys that lost their slot take others, so that nothing is sorted.
    """
    at, left = np.arange(len(keys)), None
    bits = max(10, len(keys).bit_length())
    for turn in range(4):
        some = keys if left is None else keys[left]
        slot = ((some * (mix64(np.array([turn + 1], _U)) | _U(1))) >> _U(64 - bits)).astype(np.int64)
        own = np.empty(1 << bits, np.int64)
        own[slot] = at if left is None else left
        found = own[slot]
        lost = keys[found] != some
        if left is None:
            at, left = found, np.flatnonzero(lost)
        else:
            at[left] = found
            left = left[lost]
        if not len(left):
            break
    if len(left):
        _, first, which = np.unique(keys[left], return_index=True, return_inverse=True)
        at[left] = left[first][which]
    one = at == np.arange(len(keys))
    return np.flatnonzero(one), (np.cumsum(one) - 1)[at]


def text_counts(data: np.ndarray, off: np.ndarray, n_forms: int = BANDS * ROWS) -> dict[str, np.ndarray]:
    """The simple counts of each text, whether it reads like prose, and its forms, each the least of other hashes of its 3-word windows.

    Two texts share a form with the chance of a window of either being one of both.
    """
    factors = mix64(np.arange(n_forms, dtype=_U)) | _U(1)
    n = len(off) - 1
    words = split_words(data, off, SPACED, False)
    starts_character = (data & 0xC0) != 0x80
    window, at_text = ngram_hashes(words, 3)
    repeat, forms = np.zeros(n, np.int64), np.zeros((n, n_forms), np.int64)
    if len(window):
        at = np.flatnonzero(np.concatenate([[True], at_text[1:] != at_text[:-1]]))
        own = at_text[at]
        for k in range(n_forms):
            forms[own, k] = np.minimum.reduceat(window * factors[k], at).view(np.int64)
        where = words.text_of()
        first = np.flatnonzero(where[: len(where) - 2] == where[2:])
        _, which = distinct(window ^ mix64(at_text.astype(_U)))
        hit = first[np.bincount(which)[which] > 1]
        covered = np.zeros(len(where), bool)
        for k in range(3):
            covered[hit + k] = True
        repeat = np.bincount(where[covered], minlength=n)
    word_chars = _per_text(marked(data, SPACED) & starts_character, off)
    return {
        "n_words": words.counts,
        "word_chars": word_chars,
        "n_symbols": _per_text(marked(data, _SYMBOL_BYTES), off),
        "n_dup_lines": _dup_lines(data, off),
        "n_repeat_words": repeat,
        "forms": forms,
        "prose": (_per_text(marked(data, _PUNCTUATION), off) <= MOST_PUNCTUATION * word_chars) & (_per_text(marked(data, _CAPITALS), off) <= MOST_CAPITALS * word_chars),
    }


def _salt(half: int, model: str) -> np.uint64:
    """What tells apart the n-grams of a half's model of a language, or of all."""
    return np.uint64(int.from_bytes(hashlib.sha256(f"{half} {model}".encode()).digest()[:8], "little"))


#: The name of the model of all languages together; a language's own is "of " and its name, or "none".
ALL = "all"


def _hash(columns) -> np.ndarray:
    """Hashes of n-grams of one order, given by the code points at each of their places."""
    h = np.full(len(columns[0]) if len(columns) else 0, len(columns) + 1, _U)
    for points in columns:
        h *= _U(0xD6E8FEB86659FD93)
        h += points
    return h


def _key(grams: np.ndarray, salt) -> np.ndarray:
    """Keys of n-grams, rows of code points, of one order in the models of the salts."""
    h = _hash(grams.T) if grams.shape[1] else np.ones(len(grams), _U)
    return mix64(h ^ salt)


def _symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol and at each text's end: all code points, where it begins, its hash, and its text."""
    n = np.array([len(t) + 1 for t in texts], np.int64)
    pad = BEFORE * (order - 1)
    seq = np.frombuffer("".join([pad + t.replace("\0", NUL) + AFTER for t in texts]).encode("utf-32-le"), np.uint32).astype(_U)
    text = np.repeat(np.arange(len(texts)), n)
    first = np.arange(len(text)) + text * (order - 1)
    return seq, first, _hash([seq[k : len(seq) - order + 1 + k] for k in range(order)])[first], text


def _pieces(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about so many symbols."""
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > size:
            yield i, j
            i, total = j, 0
        total += len(t)
    if texts:
        yield i, len(texts)


def _unpacked(column: pa.Array) -> list[str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x.as_buffer()).decode() for x in column]


_GRAMS = "half int, model string, gram string, n long"


def _counts(order: int):
    """Counts of n-grams by half and language."""

    def passed_on(held: list) -> pa.RecordBatch:
        keys, grams, which, n = (np.concatenate(x) for x in zip(*held[1], strict=True))
        first, at = distinct(keys)
        halves, names = (pa.array(x, t) for x, t in zip(zip(*held[0], strict=True), (pa.int32(), pa.string()), strict=True))
        grams = np.ascontiguousarray(grams[first]).astype(np.uint32).view(f"<U{grams.shape[1]}").ravel()
        which = pa.array(which[first])
        return pa.RecordBatch.from_arrays([halves.take(which), names.take(which), pa.array(grams, pa.string()), pa.array(np.bincount(at, n).astype(np.int64))], names=["half", "model", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [{}, []]
        size = 0
        for batch in batches:
            texts = _unpacked(batch.column("packed"))
            models = [*zip(batch.column("half").to_pylist(), batch.column("model").to_pylist(), strict=True)]
            for i, j in _pieces(texts):
                seq, at, hashed, text = _symbols(texts[i:j], order)
                which = np.array([held[0].setdefault(m, len(held[0])) for m in models[i:j]])[text]
                keys = hashed ^ mix64(np.arange(len(held[0]), dtype=_U))[which]
                first, group = distinct(keys)
                held[1].append((keys[first], seq[at[first][:, None] + np.arange(order)].astype(np.uint32), which[first], np.bincount(group)))
                size += len(first)
                if size > HELD:
                    yield passed_on(held)
                    held, size = [{}, []], 0
        if size:
            yield passed_on(held)

    return run


def fit_kneser_ney(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """Rows (half, model, gram, p, rest) from (half, model, gram, n) of the highest order.

    The highest order has counts, lower ones the number of different symbols
    before an n-gram; each order of a model has three discounts of its own from
    its counts of counts.  p is P(last symbol | the others), interpolated down to
    UNSEEN; rest is the mass that an n-gram leaves to lower orders as a context.
    """
    own = ["half", "model"]
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = scratch.save(levels[k + 1].groupBy(*own, F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"level-{k}")
    lower, tables = None, []
    for k in range(1, order + 1):
        seen = [F.greatest(F.count_if(F.col("n") == c), F.lit(1)).alias(f"n{c}") for c in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = [F.least(F.greatest(c - (c + 1) * y * F.col(f"n{c + 1}") / F.col(f"n{c}"), F.lit(0.1)), F.lit(0.9 * c)).alias(f"d{c}") for c in (1, 2, 3)]
        discounts = levels[k].groupBy(*own).agg(*seen).select(*own, *cut)
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = levels[k].join(discounts, own).select(*own, "gram", F.substring("gram", 1, k - 1).alias("context"), "n", discount.alias("discount"))
        # a context has at most as many rows as there are different symbols
        beside = Window.partitionBy(*own, "context")
        grams = grams.withColumns({"total": F.sum("n").over(beside), "held": F.sum("discount").over(beside), "nth": F.row_number().over(beside.orderBy("gram"))})
        grams = grams.select(*own, "gram", "context", "nth", ((F.col("n") - F.col("discount")) / F.col("total")).alias("seen"), (F.col("held") / F.col("total")).alias("rest"))
        if lower is None:
            grams = grams.withColumn("p", F.col("seen") + F.col("rest") * F.lit(UNSEEN))
        else:
            grams = grams.withColumn("shorter", F.substring("gram", 2, k - 1)).join(lower.select(*own, F.col("gram").alias("shorter"), F.col("p").alias("backed")), [*own, "shorter"])
            grams = grams.withColumn("p", F.col("seen") + F.col("rest") * F.col("backed"))
        lower = scratch.save(grams.select(*own, "gram", "context", "nth", "rest", "p"), f"order-{k}")
        tables.append(lower.select(*own, "gram", "p", F.lit(None).cast("double").alias("rest")))
        tables.append(lower.where("nth = 1").select(*own, F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "rest"))
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every.groupBy(*own, "gram").agg(F.max("p").alias("p"), F.max("rest").alias("rest"))


_HASHED = "key long, p float, rest float"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model's rows by the hash of their n-gram; what an n-gram isn't (seen, or a context) is 0 and 1."""
    for batch in batches:
        half, model, grams = (batch.column(c).to_pylist() for c in ("half", "model", "gram"))
        salts: dict = {}
        salt = np.array([salts.setdefault(m, _salt(*m)) for m in zip(half, model, strict=True)], _U)
        size = np.array([len(g) for g in grams])
        key = np.zeros(len(grams), _U)
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            points = np.frombuffer("".join([grams[x] for x in at]).encode("utf-32-le"), np.uint32).reshape(len(at), k).astype(_U)
            key[at] = _key(points, salt[at])
        p, rest = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("p", "rest"))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.nan_to_num(p, nan=0.0)), pa.array(np.where(np.isnan(rest), np.float32(1), rest))], names=["key", "p", "rest"])


@dataclass
class KneserNey:
    """The sorted hash array: the probability of each n-gram, and the mass it leaves as a context."""

    order: int
    keys: np.ndarray
    p: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, order: int, table: pa.Table) -> KneserNey:
        keys = table.column("key").to_numpy().view(_U)
        by = np.argsort(keys)
        return cls(order, keys[by], table.column("p").to_numpy()[by], table.column("rest").to_numpy()[by])

    @cached_property
    def _begin(self) -> tuple[np.uint64, np.ndarray]:
        """Where keys of each beginning start, so that a search has few steps; and the bits that follow a beginning."""
        bits = max(1, len(self.keys).bit_length())
        after = _U(64 - bits)
        return after, np.searchsorted(self.keys, np.arange(1 << bits, dtype=_U) << after).astype(np.int32)

    def _find(self, wanted: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(wanted), missing)
        if not len(self.keys):
            return out
        after, begin = self._begin
        at, left, last = begin[wanted >> after], np.arange(len(wanted)), len(self.keys) - 1
        while len(left):
            np.minimum(at, last, out=at)
            here = self.keys[at]
            same = here == wanted
            out[left[same]] = values[at[same]]
            more = (here < wanted) & (at < last)
            left, wanted, at = left[more], wanted[more], at[more] + 1
        return out

    def probability(self, grams: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """P(last symbol | the others): of the longest n-gram that was seen, times what longer contexts leave."""
        out, weight, left = np.zeros(len(grams)), np.ones(len(grams)), np.arange(len(grams))
        for k in range(self.order, 0, -1):
            some = grams[left, self.order - k :]
            p = self._find(_key(some, salt[left]), self.p, 0.0)
            out[left] = weight[left] * p
            left, some = left[p == 0], some[p == 0]
            if not len(left):
                return out
            weight[left] *= self._find(_key(some[:, :-1], salt[left]), self.rest, 1.0)
        out[left] = weight[left] * UNSEEN
        return out


def text_bits(m: KneserNey, texts: list[str], halves: list[int], names: list[str]) -> np.ndarray:
    """Bits a symbol of each text, by the models of the other half."""
    out = np.zeros(len(texts))
    salts: dict = {}
    for i, j in _pieces(texts):
        seq, begin, hashed, text = _symbols(texts[i:j], m.order)
        models = [(1 - h, x) for h, x in zip(halves[i:j], names[i:j], strict=True)]
        own = np.array([salts.setdefault(x, _salt(*x)) for x in models], _U)[text]
        every = np.array([_salt(0, ALL), _salt(1, ALL)], _U)[1 - np.array(halves[i:j])][text]
        first, at = distinct(hashed ^ own)
        grams, own, every = seq[begin[first][:, None] + np.arange(m.order)], own[first], every[first]
        bits = -np.log2((m.probability(grams, own) + m.probability(grams, every)) / 2)[at]
        out[i:j] = np.bincount(text, bits, j - i) / np.bincount(text, minlength=j - i)
    return out


def _wanted(order: int, texts: list[str], halves: list[int], names: list[str]) -> np.ndarray:
    """Keys, sorted, of all n-grams and contexts that the probabilities of the texts may ask for."""
    out, salts = [np.zeros(0, _U)], {}
    for i, j in _pieces(texts):
        seq, begin, hashed, text = _symbols(texts[i:j], order)
        own = np.array([salts.setdefault((1 - h, x), _salt(1 - h, x)) for h, x in zip(halves[i:j], names[i:j], strict=True)], _U)[text]
        every = np.array([_salt(0, ALL), _salt(1, ALL)], _U)[1 - np.array(halves[i:j])][text]
        first, _ = distinct(hashed ^ own)
        grams = seq[begin[first][:, None] + np.arange(order)]
        for salt in (own[first], every[first]):
            out += [np.unique(_key(grams[:, order - k : order - end], salt)) for k in range(1, order + 1) for end in (0, 1)]
    return np.unique(np.concatenate(out))


_PIECE = "piece long, row_ids array<long>, texts array<string>, halves array<int>, names array<string>"


def _pieces_of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that pass the base rules, many in a row, by number."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j, data, off in chunks(batch.column("text")):
            found = text_counts(data, off, 1)
            at = pa.array(np.flatnonzero(~_failed(found)))
            some = batch.slice(i, j - i).take(at)
            halves = half_of(found["forms"])[at.to_numpy()].tolist()
            yield pa.RecordBatch.from_pydict({"piece": pa.array([number], pa.int64()), "row_ids": pa.array([some.column("row_id").to_pylist()], pa.list_(pa.int64())), "texts": pa.array([some.column("text").to_pylist()], pa.list_(pa.string())), "halves": pa.array([halves], pa.list_(pa.int32())), "names": pa.array([some.column("model").to_pylist()], pa.list_(pa.string()))})
            number += 1


def _binaries(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Binary values that hold values[edge[i] : edge[i + 1]]."""
    return pa.array([values[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())


_MET = "segment int, side int, piece long, keys binary, p binary, rest binary"


def _by_segment(keys: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The segments that sorted keys are in, and where each begins."""
    segment = (keys >> _U(64 - SEGMENT_BITS)).astype(np.int32)
    own = np.unique(segment)
    return pa.array(own), np.append(np.searchsorted(segment, own), len(keys))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model's rows (key, p, rest), sorted by segment and key as unsigned numbers, packed."""
    for batch in batches:
        keys, p, rest = (batch.column(c).to_numpy() for c in ("key", "p", "rest"))
        keys = keys.view(_U)
        by = np.argsort(keys)
        own, edge = _by_segment(keys[by])
        n = len(own)
        yield pa.RecordBatch.from_arrays([own, pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), *(_binaries(x[by], edge) for x in (keys, p, rest))], names=["segment", "side", "piece", "keys", "p", "rest"])


def _asked(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts, halves, names in zip(*(batch.column(c).to_pylist() for c in ("piece", "texts", "halves", "names")), strict=True):
                keys = _wanted(order, texts, halves, names)
                own, edge = _by_segment(keys)
                n = len(own)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.ones(n, np.int32)), pa.array(np.full(n, piece, np.int64)), _binaries(keys, edge), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["segment", "side", "piece", "keys", "p", "rest"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a segment of the model says on the keys it is asked for; its rows come before what is asked."""
    now, parts, model = None, [], None
    for batch in batches:
        for segment, side, piece, keys, p, rest in zip(*(batch.column(c).to_pylist() for c in ("segment", "side", "piece", "keys", "p", "rest")), strict=True):
            if segment != now:
                now, parts, model = segment, [], None
            if side == 0:
                parts.append((np.frombuffer(keys, _U), np.frombuffer(p, np.float32), np.frombuffer(rest, np.float32)))
                continue
            if model is None:
                held = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, _U), np.zeros(0, np.float32), np.zeros(0, np.float32)]
                by = np.argsort(held[0])
                model = [x[by] for x in held]
            wanted = np.frombuffer(keys, _U)
            at = np.minimum(np.searchsorted(model[0], wanted), max(len(model[0]) - 1, 0))
            found = at[model[0][at] == wanted] if len(model[0]) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "segment": pa.array([segment], pa.int32())} | {c: pa.array([x[found].tobytes()], pa.binary()) for c, x in zip(("keys", "p", "rest"), model, strict=True)})


def _assembled(order: int):
    """Bits of a piece's texts by the part of the model that was found for it, which follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, parts = None, []

        def done() -> pa.RecordBatch:
            keys, p, rest = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x[k], t) for x in parts)]) for k, t in enumerate((_U, np.float32, np.float32)))
            bits = text_bits(KneserNey(order, keys, p, rest), piece["texts"], piece["halves"], piece["names"])
            return pa.RecordBatch.from_arrays([pa.array(piece["row_ids"], pa.int64()), pa.array(bits)], names=["row_id", "bits"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] < 0:
                    if piece is not None:
                        yield done()
                    piece, parts = row, []
                else:
                    parts.append((row["keys"], row["p"], row["rest"]))
        if piece is not None:
            yield done()

    return run


def _bits_by_shuffle(rows: DataFrame, fitted: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """Rows (row_id, bits) of texts that pass the base rules: what a piece of text asks of the model meets its segments, and the answers the piece, in shuffles."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = scratch.save(rows.mapInArrow(_pieces_of_text, _PIECE), "pieces")
    both = fitted.mapInArrow(_held, _MET).unionByName(pieces.mapInArrow(_asked(order), _MET))
    answers = both.repartition(n, "segment").sortWithinPartitions("segment", "side").mapInArrow(_answered, "piece long, segment int, keys binary, p binary, rest binary")
    whole = pieces.withColumn("segment", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    return whole.repartition(n, "piece").sortWithinPartitions("piece", "segment").mapInArrow(_assembled(order), "row_id long, bits double")


def half_of(forms: np.ndarray) -> np.ndarray:
    """The half of all texts that each is in; texts of one form are in one."""
    return (mix64(forms[:, 0].view(_U)) & _U(1)).astype(np.int32)


def bands_of(forms: np.ndarray) -> np.ndarray:
    """The bands of each text: hashes of ROWS forms.

    Two texts of similarity s share one with chance 1 - (1 - s^ROWS)^BANDS:
    0.0002 at 0.2, 0.05 at 0.5, 0.97 at 0.94.
    """
    out = np.zeros((len(forms), BANDS), _U)
    for k in range(ROWS):
        out = mix64(out + forms[:, k::ROWS].view(_U))
    return out.view(np.int64)


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts that pass the base rules, what tells whether they train, and like which others."""
    for batch in batches:
        for i, j, data, off in chunks(batch.column("text")):
            found = text_counts(data, off)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(found["forms"]).ravel()), BANDS).cast(pa.list_(pa.int64()))
            out = {c: batch.column(c).slice(i, j - i) for c in ("model", "text_hash")} | {"odd": pa.array(~found["prose"]), "half": pa.array(half_of(found["forms"])), "bands": bands}
            yield pa.RecordBatch.from_pydict(out).filter(pa.array(~_failed(found)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack(x.as_buffer()) for x in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_pydict({"model": batch.column("model"), "text_hash": batch.column("text_hash"), "packed": pa.array(packed, pa.binary())})


def _score(model, place: int | None):
    """Counts and bits of texts, which are a column or, so that they come once only, in this place of the struct `row`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = [c for c in batch.schema.names if c != "text"]
            column = batch.column("text") if place is None else batch.column("row").field(place)
            for i, j, data, off in chunks(column):
                some, found = batch.slice(i, j - i), text_counts(data, off, 1)
                failed = _failed(found)
                at = np.flatnonzero(~failed)
                texts = column.slice(i, j - i).take(pa.array(at)).to_pylist()
                bits, symbols = np.full(j - i, np.nan), np.zeros(j - i, np.int64)
                if model is not None:
                    bits[at] = text_bits(model.value, texts, half_of(found["forms"])[at].tolist(), some.column("model").take(pa.array(at)).to_pylist())
                symbols[at] = [len(t) + 1 for t in texts]
                out = {c: some.column(c) for c in carried} | {c: pa.array(found[c].astype(np.int64)) for c in _BASE}
                yield pa.RecordBatch.from_pydict(out | {"base_failed": pa.array(failed), "bits": pa.array(bits, from_pandas=True), "symbols": pa.array(symbols)})
        pa.default_memory_pool().release_unused()  # the worker lives on, beside the stages to come

    return run


def quality_rules(docs: DataFrame, order: int = 4, width: float = 6.0, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False, most_grams: int = MOST_GRAMS) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits, low, high, kept), one for each row of docs.

    bits is the text's log2 perplexity a symbol; texts that fail the base rules
    have none.  A document is kept if it passes the base rules and its bits are
    within `width` robust deviations (1.4826 times the median absolute one,
    which counts as `LEAST_SPREAD` at least) of the median of its language.
    Deviations of short texts, which are larger by chance, count for less: by
    the root of symbols / (symbols + SHORT).  Of equal texts, and of nearly equal
    ones that share a band (`bands_of`), one counts in the model, the median and
    the deviation; all other texts do, however many words they have in common.
    Null and empty texts have no words and fail; a null language counts as one;
    any number of languages have models and bands of their own; repeated rows
    and ids are judged one by one; other columns are not read, but with keep
    they come along in a struct `row` and may have any names.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    text, lang = F.col(text_col), F.col(lang_col)
    place = docs.columns.index(text_col) if keep and text_col in docs.columns else None
    keys = [F.coalesce(F.concat(F.lit("of "), lang), F.lit("none")).alias("model"), F.xxhash64(text).alias("text_hash")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, *([F.struct("*").alias("row")] if keep else []), *([text.alias("text")] if place is None else []))
    texts = docs.select(*keys, text.alias("text")).where("text is not null")
    # of texts that share a band one stays, for one band after another
    single = texts.mapInArrow(_candidates, "model string, text_hash long, odd boolean, half int, bands array<long>")
    for k in range(BANDS):
        single = single.groupBy("model", F.col("bands")[k]).agg(F.min(F.struct("odd", "text_hash", "half", "bands")).alias("one")).select("model", "one.*")
    single = scratch.save(single.drop("bands"), "single")
    both = ["model", "text_hash"]
    # copies meet on their way, and what trains is found by the same partitioning
    packed = texts.mapInArrow(_pack, "model string, text_hash long, packed binary").groupBy(*both).agg(F.min("packed").alias("packed"))
    train = packed.join(single.where("not odd").select(*both, "half"), both)
    counts = train.select("half", "model", "packed").mapInArrow(_counts(order), _GRAMS).groupBy("half", "model", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "grams")
    every = counts.groupBy("half", "gram").agg(F.sum("n").alias("n")).withColumn("model", F.lit(ALL))
    fitted = fit_kneser_ney(scratch.save(counts.unionByName(every), "all-grams"), order, scratch).mapInArrow(_hashed, _HASHED)
    fitted = scratch.save(fitted, "model")
    small = fitted.count() <= most_grams
    if not small:  # the numbers must stay the same
        rows = scratch.save(rows.withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    model = spark.sparkContext.broadcast(KneserNey.of(order, fitted.toArrow())) if small else None
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    scored = scratch.save(rows.mapInArrow(_score(model, place), f"{carried}, {', '.join(f'{c} long' for c in _BASE)}, base_failed boolean, bits double, symbols long"), "scored")
    if small:
        model.unpersist()
    else:
        whole = F.col("text") if place is None else F.col("row").getField(text_col)
        bits = _bits_by_shuffle(rows.select("row_id", "model", whole.alias("text")), fitted, order, scratch)
        scored = scratch.save(scored.drop("bits").join(bits, "row_id", "left"), "rescored")
    # rounded, a language has a bounded number of different values, so that exact percentiles are cheap
    weight = F.sqrt(F.greatest("symbols", F.lit(1)) / (F.col("symbols") + SHORT))
    one = scratch.save(scored.where("bits is not null").groupBy(*both).agg(F.max(F.struct(F.round("bits", 4).alias("rounded"), weight.alias("weight"))).alias("one")).join(single, both, "left_semi").select("model", "one.*"), "alone")
    middle = scratch.save(one.groupBy("model").agg(F.percentile("rounded", F.lit(0.5)).alias("middle")), "middle")
    held = F.broadcast if middle.count() <= FEW else lambda table: table  # a row for each language
    off = F.round(F.abs(F.col("rounded") - F.col("middle")) * F.col("weight"), 4)
    spread = one.join(held(middle), "model").groupBy("model", "middle").agg(F.percentile(off, F.lit(0.5)).alias("spread"))
    bands = spread.select("model", "middle", (width * 1.4826 * F.greatest("spread", F.lit(LEAST_SPREAD))).alias("reach"))
    found = scored.join(held(bands), "model", "left").withColumns({"low": F.col("middle") - F.col("reach") / weight, "high": F.col("middle") + F.col("reach") / weight})
    kept = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False)) & ~F.col("base_failed")
    return found.select("doc_id", *_BASE, "base_failed", "bits", "low", "high", kept.alias("kept"), *(["row"] if keep else []))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, judged by base counts and by perplexity bands of its languages."""
    return quality_rules(read_table(spark, sf_dir, "documents")).drop("bits", "low", "high")
