"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards, sorts a shard's word suffixes, and
binary-searches the suffixes of the benchmark texts in it, word after word
until no training suffix goes on: that is the suffix's longest verbatim match,
and the run of sorted suffixes it leaves are its places.  Suffixes whose first
window of words doesn't stand in the shard, by its hash, can't match and aren't
searched, and a shard without any is not sorted; `lookup=False` searches all.  Matches of a window
or more are kept with item, place and length, and documents with any can then
be removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table
from .words import ALNUM, Words, chunks, mix64, split_words, text_bytes

#: Bytes of text in one suffix array, and of benchmark text that is broadcast at once.
SHARD_BYTES = 1 << 21
BLOCK_BYTES = 1 << 26

_U = np.uint64


class SuffixArray:
    """Suffixes of the word sequences of some texts, sorted as far as `depth` words, at most to where they differ.

    Words are ordered by their hashes' ranks; rank 0 ends each text, so no match
    runs from one text into the next.  A query of up to `depth` words finds
    exactly the places it would find in a fully sorted array.
    """

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, depth: int):
        self.words, rank = np.unique(hashes, return_inverse=True)
        n_texts = len(offsets) - 1
        ends = np.repeat(np.arange(n_texts), np.diff(offsets))
        self.seq = np.zeros(len(hashes) + n_texts, np.int64)
        self.seq[np.arange(len(hashes)) + ends] = rank + 1
        n, known = len(self.seq), 1
        self.order = np.argsort(self.seq, kind="stable")
        value = self.seq[self.order]
        level = np.empty(n, np.int64)  # a suffix's rank is the first place of those equal to it so far
        level[self.order] = np.searchsorted(value, value)
        open_ = np.flatnonzero(self._tied(level[self.order]))
        while known < depth and len(open_):  # prefix doubling over the suffixes that still tie
            at = self.order[open_]
            after = np.where(at + known < n, level[np.minimum(at + known, n - 1)], -1)
            by = np.lexsort((after, level[at]))
            at, mine, after = at[by], level[at][by], after[by]
            self.order[open_] = at
            new = np.ones(len(at), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (after[1:] != after[:-1])
            level[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            open_ = open_[self._tied(level[at])]
            known *= 2

    @staticmethod
    def _tied(level: np.ndarray) -> np.ndarray:
        same = np.zeros(len(level) + 1, bool)
        same[1:-1] = level[1:] == level[:-1]
        return same[1:] | same[:-1]

    def longest(self, rank: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For query suffixes that begin at places `at` of rank: words of the longest match of up to `left` words, and the run of sorted suffixes that have it."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        length = np.zeros_like(lo)
        on, d = np.flatnonzero(left > 0), 0
        while len(on):
            word = rank[at[on] + d] + 1
            a, b = self._bound(lo[on], hi[on], d, word, False), self._bound(lo[on], hi[on], d, word, True)
            found = (a < b) & (word > 0)
            on, d = on[found], d + 1
            lo[on], hi[on], length[on] = a[found], b[found], d
            on = on[left[on] > d]
        return length, lo, hi

    def without_before(self, lo: np.ndarray, hi: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k, i) for the sorted suffixes i in lo[k]..hi[k] that don't follow the word before[k].

        Sorted suffixes are taken in stretches that follow one word.  Of two
        neighbouring stretches one is wanted, so that no more than twice the
        wanted ones are looked at, however long the runs are.
        """
        word = np.where(self.order > 0, self.seq[self.order - 1], -3)
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), word[1:] != word[:-1]]))
        b0, b1 = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi - 1, "right")
        k, stretch = _ranges(b0, b1 - b0)
        wanted = word[first[stretch]] != before[k]
        k, stretch = k[wanted], stretch[wanted]
        start, end = np.maximum(first[stretch], lo[k]), np.minimum(np.append(first, len(word))[stretch + 1], hi[k])
        of, i = _ranges(start, end - start)
        return k[of], i

    def _bound(self, lo: np.ndarray, hi: np.ndarray, d: int, word: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = self.order[np.minimum(mid, len(self.order) - 1)] + d
            value = np.where(at < len(self.seq), self.seq[np.minimum(at, len(self.seq) - 1)], -1)
            right = open_ & ((value <= word) if after else (value < word))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, i) for the n[k] numbers i from first[k] on."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def _run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, where n are left."""
    out = np.zeros(max(len(hashes) - n + 1, 0), _U)
    for k in range(n if len(out) else 0):
        out = out * _U(0xFF51AFD7ED558CCD) + hashes[k : len(hashes) - n + 1 + k]
    return mix64(out)


@dataclass
class Queries:
    """Words of some benchmark texts one after another, and what each suffix needs: a window, or a shorter item whole."""

    ids: list[str]
    hashes: np.ndarray
    first: np.ndarray  # first word of each item
    item: np.ndarray  # item each word is in
    left: np.ndarray  # words from here to the item's end
    need: np.ndarray  # words that make a hit; 0 where too few are left
    windows: dict[int, tuple[np.ndarray, np.ndarray]]  # by need: sorted hashes of the first `need` words, and the places they are from

    @classmethod
    def of(cls, ids: list[str], texts: list[str | None], width: int) -> Queries:
        data, off = text_bytes(pa.array(texts, pa.string()))
        words = split_words(data, off, ALNUM, True)
        item = words.text_of()
        left = words.offsets[item + 1] - np.arange(len(item))
        need = np.minimum(width, words.counts[item])
        need[left < need] = 0
        windows = {}
        for n in np.unique(need[need > 0]).tolist():
            at = np.flatnonzero(need == n)
            hashed = _run_hashes(words.hash, n)[at]
            order = np.argsort(hashed, kind="stable")
            windows[n] = hashed[order], at[order]
        return cls(ids, words.hash, words.offsets[:-1], item, left, need, windows)

    def present(self, words: Words) -> np.ndarray:
        """Places of suffixes whose first `need` words stand in the texts, by hash."""
        found = []
        for n, (hashed, at) in self.windows.items():
            own = np.unique(_run_hashes(words.hash, n))
            found.append(at[_among(hashed, own)])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _among(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which values of a sorted array are in another sorted one; the shorter one is searched for in the longer."""
    if len(others) < len(some):
        first, last = np.searchsorted(some, others), np.searchsorted(some, others, side="right")
        mark = np.zeros(len(some) + 1, np.int64)
        np.add.at(mark, first, 1)
        np.subtract.at(mark, last, 1)
        return np.cumsum(mark[:-1]) > 0
    at = np.minimum(np.searchsorted(others, some), max(len(others) - 1, 0))
    return others[at] == some if len(others) else np.zeros(len(some), bool)


_FIELDS = ("text", "item", "item_first", "first", "words")


def shard_matches(words: Words, q: Queries, lookup: bool = True) -> np.ndarray:
    """Rows of _FIELDS for every verbatim match of a window or more that can't go on to either side in its item and text."""
    at = q.present(words) if lookup else np.flatnonzero(q.need > 0)
    if not len(at) or not len(words.hash):
        return np.zeros((0, len(_FIELDS)), np.int64)
    array = SuffixArray(words.hash, words.offsets, int(q.left[at].max()))
    place = np.minimum(np.searchsorted(array.words, q.hashes), len(array.words) - 1)
    rank = np.where(array.words[place] == q.hashes, place, -2)
    window, run_lo, run_hi = array.longest(rank, at, q.need[at])
    whole = window == q.need[at]
    at, run_lo, run_hi = at[whole], run_lo[whole], run_hi[whole]
    # a match begins where the words before differ, or where the item or the text does
    of, nth = array.without_before(run_lo, run_hi, np.where(at == q.first[q.item[at]], -2, rank[at - 1] + 1))
    starts, of = np.unique(of, return_inverse=True)
    longest, lo, hi = array.longest(rank, at[starts], q.left[at[starts]])
    suffix, here = at[starts][of], array.order[nth]
    item, top = q.item[suffix], (nth >= lo[of]) & (nth < hi[of])
    length = np.where(top, longest[of], q.need[suffix])
    on = np.flatnonzero(~top)
    while len(on):  # places of the window that don't have the suffix's longest match
        p, s = here[on] + length[on], suffix[on] + length[on]
        more = (length[on] < q.left[suffix[on]]) & (array.seq[np.minimum(p, len(array.seq) - 1)] == rank[np.minimum(s, len(rank) - 1)] + 1) & (array.seq[np.minimum(p, len(array.seq) - 1)] > 0)
        on = on[more]
        length[on] += 1
    text_start = words.offsets[:-1] + np.arange(len(words))
    text = np.searchsorted(text_start, here, side="right") - 1
    out = np.stack([text, item, suffix - q.first[item], here - text_start[text], length], 1)
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 3], out[:, 0]))]


_MATCH = "array<struct<item_id:string,item_first:long,first:long,words:long>>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_first", pa.int64()), ("first", pa.int64()), ("words", pa.int64())]))


def _search(block: Broadcast, only_found: bool):
    """Adds n_words and matches to the rows, or gives row_id and matches of those with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = block.value
        names = pa.array(q.ids, pa.string())
        for batch in batches:
            for i, j, data, off in chunks(batch.column("text"), SHARD_BYTES):
                words = split_words(data, off, ALNUM, True)
                found = shard_matches(words, q)
                edge = pa.array(np.searchsorted(found[:, 0], np.arange(j - i + 1)).astype(np.int32))
                each = pa.StructArray.from_arrays([names.take(pa.array(found[:, 1])), *(pa.array(found[:, k]) for k in (2, 3, 4))], fields=list(_MATCHES.value_type))
                matches = pa.ListArray.from_arrays(edge, each).cast(_MATCHES)
                if only_found:
                    some = pa.array(np.unique(found[:, 0]))
                    yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(i, j - i).take(some), matches.take(some)], names=["row_id", "matches"])
                    continue
                out = {c: batch.column(c).slice(i, j - i) for c in batch.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(words.counts, pa.int64()), "matches": matches})

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[str], list[str | None]]]:
    """Benchmark texts a bounded number of bytes at a time; the driver holds one block."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null").toLocalIterator():
        if ids and size + len(row.t or "") > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t or "")
    yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, matches, n_hit, items, items_sha256), one for each row of docs.

    matches are all longest verbatim matches of at least `width` words, or of a
    shorter item whole, as (item_id, item_first, first, words): where they begin
    in the item and in the document, and how many words they have.  n_hit counts
    the words inside any match; items are the ids of items with a match, sorted.
    Null and empty texts have no words and no matches; items without words or
    without an id are never found; repeated rows and ids are each reported; an
    empty benchmark finds nothing.  With keep, all columns of docs come along in
    a struct `row` and may have any names.

    One pass without a shuffle while the benchmark has at most BLOCK_BYTES of
    text.  A larger one takes a pass for each block over a saved copy of the
    texts; only documents with matches leave those passes.
    """
    sc = docs.sparkSession.sparkContext
    state = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if keep else []))
    blocks = _blocks(benchmark, item_col, item_text_col)
    block, following = next(blocks), next(blocks, None)
    if following is not None:  # all passes must see the same numbers
        scratch = scratch or Scratch(docs.sparkSession, "contamination")
        state = scratch.save(state.withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    kept = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields if f.name != "text"])
    found = state.mapInArrow(_search(sc.broadcast(Queries.of(*block, width)), False), f"{kept}, n_words long, matches {_MATCH}")
    others = None
    for k, block in enumerate([] if following is None else _chain(following, blocks)):
        held = sc.broadcast(Queries.of(*block, width))
        one = scratch.save(state.select("row_id", "text").mapInArrow(_search(held, True), f"row_id long, matches {_MATCH}"), f"block-{k}")
        held.destroy()
        others = one if others is None else others.unionByName(one)
    if others is not None:
        more = others.groupBy("row_id").agg(F.flatten(F.collect_list("matches")).alias("more"))
        found = found.join(more, "row_id", "left").withColumn("matches", F.array_sort(F.concat("matches", F.coalesce("more", F.array().cast(_MATCH))), _by_place)).drop("more", "row_id")
    span = F.array_sort(F.transform("matches", lambda m: F.struct(m["first"].alias("first"), (m["first"] + m["words"]).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(span, start, lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0), m["end"] - F.greatest(m["first"], a["end"]))).alias("n"), F.greatest(a["end"], m["end"]).alias("end")))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.withColumns({"n_hit": covered["n"], "items": items}).withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256))


def _chain(first, others) -> Iterator:
    yield first
    yield from others


def _by_place(a, b):
    x, y = F.struct(a["first"], a["item_id"], a["item_first"]), F.struct(b["first"], b["item_id"], b["item_first"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` against all of `benchmark`; beside the digest, where the longest of a document's matches begins (ties: first, then item)."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    longest = F.array_min(F.transform("matches", lambda m: F.struct((-m["words"]).alias("less"), m["first"].alias("first"), m["item_id"].alias("item_id"), m["item_first"].alias("item_first"))))
    return found.withColumn("best", longest).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(-F.col("best.less"), F.lit(0)).alias("longest"), F.col("best.first").alias("longest_first"), F.col("best.item_id").alias("longest_item"), F.col("best.item_first").alias("longest_item_first"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs."""
    return find_contamination(docs, benchmark, width, scratch, keep=True).where("n_hit = 0").select("row.*")

