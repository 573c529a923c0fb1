"""Runs of periodically repeated words, found with a suffix automaton whose end positions merge from small to large.

A run is a stretch with smallest period q, at least 2 q words long, that no
neighbouring word extends.  Each state of the automaton stands for strings that
end at the same places.  Up the tree of suffix links the places merge, the
smaller ordered set into the larger; two places that become neighbours there
share exactly the state's longest string, so if they are no farther apart than
its length, a square ends at the later one.  Such a seed knows where its run
begins and its period, and is extended to the right once.

Only stretches that can hold a run get an automaton: both halves of a run's
first square repeat, so all its words are covered by word sequences of half the
least length that occur twice.  Each text is settled where it is read; nothing
is shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import read_table
from .words import SPACED, Words, chunks, mix64, split_words

#: Words of the shortest run.
LEAST = 12


class _Automaton:
    """Suffix automaton of a word sequence: per state its longest string's length, its suffix link, and where it first ends (-1 for copies)."""

    def __init__(self, sequence: list[int]):
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        # most states have one way on; further ones are in a dict
        self.word, self.to, self.more = array("i", [-1]), array("i", [0]), {}
        last = 0
        for at, x in enumerate(sequence):
            last = self._append(last, at, x)

    def _state(self, length: int, link: int, end: int, word: int = -1, to: int = 0) -> int:
        for values, v in ((self.length, length), (self.link, link), (self.end, end), (self.word, word), (self.to, to)):
            values.append(v)
        return len(self.length) - 1

    def _append(self, p: int, at: int, x: int) -> int:
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.length
        new = self._state(at + 1, 0, at)
        while p >= 0:
            if word[p] == x:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = x, new
            else:
                ways = more.setdefault(p, {})
                if (q := ways.get(x)) is not None:
                    break
                ways[x] = new
            p = link[p]
        else:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = self._state(length[p] + 1, link[q], -1, word[q], to[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:  # the shorter strings now lead to the copy
            if word[p] == x and to[p] == q:
                to[p] = copy
            elif p in more and more[p].get(x) == q:
                more[p][x] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
        return new


def _seeds(sequence: list[int], least: int) -> set[tuple[int, int, int]]:
    """(start, period, end so far) of squares: two neighbouring ends of a state's string, no farther apart than its length; one for each start and period."""
    states = _Automaton(sequence)
    length, link, end = states.length, states.link, states.end
    order = np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist()
    places: list[list[int] | None] = [None] * len(order)  # a state's ends, negated and rising, so that earlier ends are appended
    seen, found = set(), set()
    for v in order:
        own = places[v]
        places[v] = None
        if end[v] >= 0:
            if own is None:
                own = [-end[v]]
            else:
                _merge(own, [-end[v]], length[v], seen, found)
        u = link[v]
        if u < 0 or length[u] < least:  # no run's half is that short, nor are those above
            continue
        if (other := places[u]) is None:
            places[u] = own
        else:
            large, small = (own, other) if len(own) > len(other) else (other, own)
            _merge(large, small, length[u], seen, found)
            places[u] = large
    return found


def _merge(large: list[int], small: list[int], length: int, seen: set, found: set) -> None:
    """Puts the places of small into large and notes new neighbours that are no farther apart than length."""
    before = None
    for k, e in enumerate(small):
        at = bisect_left(large, e)
        # values are negated: a lesser one ends later
        if at and e - large[at - 1] <= length and (before is None or before < large[at - 1]):
            _note(-e, e - large[at - 1], length, seen, found)
        if at < len(large) and large[at] - e <= length and (k + 1 == len(small) or small[k + 1] > large[at]):
            _note(-large[at], large[at] - e, length, seen, found)
        before = e
    if len(small) < 8:
        for e in small:
            if e > large[-1]:
                large.append(e)
            else:
                large.insert(bisect_left(large, e), e)
    else:
        large += small
        large.sort()


def _note(first_end: int, period: int, length: int, seen: set, found: set) -> None:
    start = first_end - length + 1
    if (start, period) not in seen:
        seen.add((start, period))
        found.add((start, period, first_end + period))


def _agree(a: np.ndarray, i: int, j: int) -> int:
    """How many words on from i and from j are equal; i < j."""
    found, width = 0, 64
    while j + found < len(a):
        y = a[j + found : j + found + width]
        differ = np.flatnonzero(a[i + found : i + found + len(y)] != y)
        if len(differ):
            return found + int(differ[0])
        found, width = found + len(y), 2 * width
    return found


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least `least` words, by start, then period; words are values to compare."""
    _, sequence = np.unique(words, return_inverse=True)
    ends: dict[tuple[int, int], int] = {}
    for start, period, last in _seeds(sequence.tolist(), (least + 1) // 2):
        end = last + 1 + _agree(sequence, last + 1 - period, last + 1)
        if end - start >= least:  # a multiple of the period has the same bounds
            ends[start, end] = min(period, ends.get((start, end), period))
    return sorted((s, e - s, q) for (s, e), q in ends.items())


def _stretches(hashes: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of stretches in which all runs lie.

    Each word of a run is in a sequence of half the least length that occurs
    twice in the run; what stretches lack that is cut out, until none does.
    """
    half, m = (least + 1) // 2, len(hashes)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if m < least:
        return none
    gram = np.zeros(m - half + 1, dtype=np.uint64)
    for k in range(half):
        gram = gram * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : m - half + 1 + k]
    at = np.arange(m - half + 1)
    within = text
    while True:
        at = at[within[at] == within[at + half - 1]]
        key = mix64(gram[at] + mix64(within[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if again.all() and within is not text or not again.any():
            break
        at = at[again]
        edge = np.zeros(m + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + half, -1)
        inside = np.concatenate([[False], np.cumsum(edge[:m]) > 0, [False]])
        begins = inside[1:-1] & (~inside[:-2] | np.concatenate([[True], text[1:] != text[:-1]]))
        within = np.where(inside[1:-1], np.cumsum(begins), -np.arange(1, m + 1))
    if not again.any():
        return none
    first = np.flatnonzero((within > 0) & np.concatenate([[True], within[1:] != within[:-1]]))
    last = np.flatnonzero((within > 0) & np.concatenate([within[1:] != within[:-1], [True]])) + 1
    long = last - first >= least
    return first[long], last[long]


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    text = words.text_of()[kept]
    counts = np.bincount(text, minlength=len(words))
    size = words.end[kept] - words.start[kept] + 1  # with the space
    total = np.bincount(text, size, minlength=len(words)).astype(np.int64)
    length = total - (counts > 0)
    out = np.empty(int(length.sum()), dtype=np.uint8)
    last = np.zeros(len(kept), dtype=bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    put, block = 0, 1 << 17
    for k in range(0, len(kept), block):
        some, n = kept[k : k + block], size[k : k + block] - last[k : k + block]
        before = np.cumsum(n) - n
        source = np.repeat(words.start[some] - before, n) + np.arange(n.sum())
        piece = words.data[np.minimum(source, len(words.data) - 1)]
        piece[(before + n - 1)[~last[k : k + block]]] = 0x20
        out[put : put + len(piece)] = piece
        put += len(piece)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                words = split_words(data, off, SPACED, False)
                text = words.text_of()
                edge = np.zeros(len(text) + 1, np.int64)
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for a, b in zip(*_stretches(words.hash, text, least), strict=True):
                    t = text[a]
                    for start, length, period in runs_of(words.hash[a:b], least):
                        found[t].append({"start": int(a - words.offsets[t]) + start, "length": length, "period": period})
                        edge[a + start + period] += 1
                        edge[a + start + length] -= 1
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words.counts), pa.array(found, pa.list_(_RUN)), _joined(words, kept)], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`.  runs holds each run of at least `least`
    words as (start, length, period), counted in words from 0 and ordered by
    start, then period.  collapsed is the text's words joined by one space,
    without those that a run holds after its first period.  A null, empty or
    wordless text has no runs and collapses to an empty text.  Null and
    repeated ids stay as they are; each row is judged by itself; an empty table
    gives no rows.  Other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_runs(least), _SCHEMA)


def with_digests(found: DataFrame) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run, of equal ones the first, then that of the least period."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.a")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.length) div (-best.q)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which one in ten, by its id's CRC-32, ends in a repeated stretch.

    With h that CRC, g = h div 10 and n words, where 10 divides h the words from
    a = g mod n on are those from a to a + p - 1 again and again, p being 1 +
    (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"))
    g = F.expr(f"crc32(cast({id_col} as string)) div 10")
    rows = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
    rows = rows.withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    place: Column = F.expr("transform(sequence(0, _n - 1), i -> element_at(_words, cast(if(i < _a, i, _a + (i - _a) % _p) as int) + 1))")
    return rows.withColumn(text_col, F.when(F.col("_n") > 0, F.array_join(place, " ")).otherwise(F.col(text_col))).drop("_words", "_n", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, one in ten with a repeated tail, searched for runs."""
    return with_digests(periodic_runs(with_tails(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))
