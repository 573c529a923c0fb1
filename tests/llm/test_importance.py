"""Importance resampling against plain Python and zlib."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rastermill.llm.importance import Resampling, drawn_rows, feature_crcs, moved_on, op11_crc_resampling, resample
from rastermill.llm.words import ALNUM as ALNUM_BYTES
from rastermill.llm.words import pieces, text_bytes
from tests.llm.brute import ALNUM, lower

ODD = [None, "", "  \n", "one", "Two words", "ünï çødé 日本語 " * 5, "x" * 100 + " tail", "a b c d e f g" * 40, "don't-stop: 42 " * 3]


def features(text, longest):
    words = ALNUM.findall(lower(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, p):
    bucket = lambda x: zlib.crc32(x.encode()) % p.buckets
    s, t = (Counter(bucket(x) for text in texts for x in features(text, p.longest)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + p.buckets) / ((s[b] + 1) * (t.total() + p.buckets))))
    out = {}
    for i, text in docs:
        found = features(text, p.longest)
        weight = sum(gain(bucket(x)) for x in found)
        h = int(hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    may = sorted((-out[i][2], i) for i, text in docs if len(features(text, 1)) >= p.least_words)
    for k, (_, i) in enumerate(may[: p.percent * len(may) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


def rows(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_crcs_of_runs_are_those_of_the_spelt_text(longest):
    found = [[] for _ in ODD]
    for _, crc, text in feature_crcs(pa.array(ODD), longest):
        for c, t in zip(crc.tolist(), text.tolist(), strict=True):
            found[t].append(c)
    assert [sorted(x) for x in found] == [sorted(zlib.crc32(x.encode()) for x in features(t, longest)) for t in ODD]


def test_runs_go_on_over_pieces(monkeypatch):
    from rastermill.llm import importance

    small = lambda *a: pieces(*a, size=7)
    monkeypatch.setattr(importance, "pieces", small)
    test_crcs_of_runs_are_those_of_the_spelt_text(4)
    data, off = text_bytes(pa.array(["Aa bb", "cc", "", "dd " * 5000]))
    assert sum(len(start) for _, start, _, _ in small(data, off, ALNUM_BYTES, True)) == 5003


def test_a_crc_moves_on_by_any_length():
    random.seed(3)
    for n in (0, 1, 7, 255, 256, 70_000):
        a, b = random.randbytes(random.randrange(1, 9)), random.randbytes(n)
        moved = moved_on(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("p", [Resampling(), Resampling(longest=3, buckets=97, percent=35, least_words=5, seed=1)])
def test_whole_table_matches_plain_python(spark, sf_dir, p):
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], p)
    found = resample(docs, target, p)
    assert rows(found) == want
    kept = drawn_rows(docs, found)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[3]}


def test_query_is_the_operator_at_its_settings(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = op11_crc_resampling(spark, sf_dir)
    assert [t for _, t in found.dtypes] == ["bigint"] * 5 and rows(found) == brute(docs, target, Resampling())


def test_nulls_empties_ties_repeats_long_texts_and_clashing_columns(spark):
    schema = "doc_id long, text string, weight string, bucket string, rank string, n string"
    long = "Lorem\tipsum dolor " * 60_000
    data = [(i, t, *"abcd") for i, t in enumerate([*ODD, long])]
    p = Resampling(least_words=1, percent=100)
    target = spark.createDataFrame([("one two", 1), (None, 2), ("", 3)], "text string, bucket int")
    want = brute([(i, t) for i, t, *_ in data], ["one two", None, ""], p)
    assert rows(resample(spark.createDataFrame(data, schema), target, p)) == want
    again = resample(spark.createDataFrame([*data, data[3], data[3], (None, "one", *"abcd")], schema), target, p).collect()
    assert sum(r["rank"] is not None for r in again) == sum(v[3] is not None for v in want.values()) + 2
    assert sorted(r["rank"] for r in again if r["rank"]) == list(range(1, 1 + sum(r["rank"] is not None for r in again)))
    (null,) = (r for r in again if r.doc_id is None)
    assert null.score is None and null["rank"] is None and null.n_features == 1
    nothing = spark.createDataFrame([], schema)
    assert resample(nothing, target, p).count() == 0
    assert rows(resample(spark.createDataFrame(data, schema), nothing, p)) == brute([(i, t) for i, t, *_ in data], [], p)
