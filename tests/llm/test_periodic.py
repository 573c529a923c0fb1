"""Runs of repeated words against trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from rastermill.llm.periodic import op13_periodic_runs, periodic_runs, runs_of, with_tails
from tests.llm.brute import SPACED


def brute_runs(words, least=12):
    """(start, length, period) by start, then period."""
    n, found = len(words), {}
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    a = np.array([code[w] for w in words], np.int64)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (a[q:] == a[:-q]).astype(int), [0]])
        turn = np.diff(same)
        for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
            if e - s >= q and e - s + q >= least and not any((a[s + d : e + q] == a[s : e + q - d]).all() for d in range(1, q)):
                found[s, e + q] = q
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tail(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_sequences_over_small_alphabets(least):
    random.seed(least)
    for k in range(400):
        n, letters = random.randrange(0, 70), random.choice([1, 2, 2, 3, 4])
        words = [random.randrange(letters) for _ in range(n)]
        if k % 3 == 0 and n:  # repeats of repeats
            part = words[: random.randrange(1, 9)]
            words = (words + part * random.randrange(2, 6) + words[:7]) * random.randrange(1, 3)
        assert runs_of(np.array(words, np.int64), least) == brute_runs(words, least), words


def test_fibonacci_words_and_powers():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    assert runs_of(np.array(b), 2) == brute_runs(b, 2)
    assert runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert runs_of(np.tile(np.arange(700), 60)) == [(0, 42_000, 700)]


def test_whole_table_matches_plain_python(spark, sf_dir):
    docs = {r.doc_id: SPACED.findall(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_periodic_runs(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    assert sum(r.n_runs > 0 for r in rows) >= len(docs) // 20
    for r in rows:
        words = tail(r.doc_id, docs[r.doc_id])
        if len(words) > 1500 and zlib.crc32(str(r.doc_id).encode()) % 10:
            continue  # the small ones and all repeated ones; the next test takes long texts
        runs = brute_runs(words) if len(words) <= 1500 else None
        if runs is None:
            assert r.n_runs and r.collapsed_sha256 == sha(collapsed(words, runs_of(np.array([zlib.crc32(w.encode()) for w in words])))), r
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(collapsed(words, runs))


def test_nulls_empties_long_texts_repeats_and_clashing_columns(spark):
    random.seed(2)
    schema = "doc_id long, text string, runs string, collapsed string, n_words string, start string"
    lines = "the cat sat down\n" * 5
    long = " ".join(f"w{random.randrange(10**6)}" for _ in range(150_000))
    texts = [None, "", " \n\t", "one", "A a " * 6, "a " * 12, "a " * 11, lines + "and left", "日本 語 " * 9, long + " " + "x y z " * 1000 + long, "  lead" + "\t\vtrail\x1f " * 8]
    data = [(k, t, *"abcd") for k, t in enumerate(texts)] + [(None, lines, *"abcd"), (7, lines + "and left", *"abcd")]
    found = periodic_runs(spark.createDataFrame(data, schema)).collect()
    assert len(found) == len(data)
    by = {(r.doc_id, r.collapsed): r for r in found}
    for i, t, *_ in data:
        words = SPACED.findall(t or "")
        runs = brute_runs(words) if len(words) < 5000 else [(150_000, 3000, 3)]
        r = by[i, collapsed(words, runs)]
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
    assert periodic_runs(spark.createDataFrame([], schema)).count() == 0


def test_tails(spark):
    docs = [(k, " ".join(f"w{i}" for i in range(k % 40))) for k in range(200)] + [(None, "a b"), (10**12, None)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n int")
    got = {r.doc_id: r.text for r in with_tails(df).collect()}
    changed = 0
    for i, t in docs:
        words = tail(i, SPACED.findall(t or "")) if i is not None else SPACED.findall(t)
        assert SPACED.findall(got[i] or "") == words
        changed += words != SPACED.findall(t or "")
    assert changed >= 8
