"""The exact join against all pairs."""

import random

import numpy as np
import pytest

from rastermill.llm.jaccard_join import JaccardJoin, _without, jaccard_join, least_common, op12_jaccard_join
from tests.llm.brute import SPACED, lower

SCHEMA = "doc_id long, text string"


def brute(docs, words=5, percent=80):
    """[(id, set size, component, class, links)] of rows [(id, text)]; rows without an id are alone."""
    sets = []
    for i, t in docs:
        w = SPACED.findall(lower(t))
        sets.append(frozenset({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())))
    n = len(docs)
    root, links, same = list(range(n)), [0] * n, [i for i, _ in docs]

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and sets[b] and docs[a][0] is not None and docs[b][0] is not None:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    links[a] += 1
                    links[b] += 1
                    root[top(a)] = top(b)
                if sets[a] == sets[b]:
                    same[a] = same[b] = min(same[a], same[b])
    least = {}
    for a in range(n):
        if docs[a][0] is not None:
            least[top(a)] = min(least.get(top(a), docs[a][0]), docs[a][0])
    by_set = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if i is not None and s:
            by_set[s] = min(by_set.get(s, i), i)
    return sorted(((i, len(s), least[top(a)], by_set.get(s, i), links[a]) if i is not None else (None, len(s), None, None, None) for a, ((i, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "class_id", "n_links").collect()), key=str)


def family(rng, base, copies, edits, first):
    out = []
    for k in range(copies):
        text = base.copy()
        for at in rng.sample(range(len(text)), rng.randint(0, edits)):
            text[at] = rng.choice(["x", f"y{rng.randrange(50)}", f"z{rng.random()}"])
        out.append((first + k, " ".join(text)))
    return out


def test_whole_table_matches_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows(op12_jaccard_join(spark, sf_dir)) == brute(docs)


@pytest.mark.parametrize("p", [JaccardJoin(), JaccardJoin(block=4, sketch=2, agree=1), JaccardJoin(words=3, percent=65, counters=64, block=7), JaccardJoin(sketch=1, agree=2), JaccardJoin(percent=95, words=1)])
def test_families_chains_and_a_shared_passage(spark, p):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(90)]
    docs = []
    for f in range(5):
        base = [f"f{f}-{rng.randrange(80)}" for _ in range(rng.randrange(40, 120))]
        docs += family(rng, base + (passage if f % 2 else []), 14, 6, 100 * f)
    chain = [f"c{k}" for k in range(150)]
    for k in range(15):  # neighbours link, ends don't
        chain = chain.copy()
        for at in rng.sample(range(150), 2):
            chain[at] = f"n{k}-{at}"
        docs.append((1000 + k, " ".join(chain)))
    docs += [(2000 + k, " ".join([*passage, *(f"o{k}-{j}" for j in range(20 + k))])) for k in range(20)]
    docs += [(3000 + k, t) for k, t in enumerate(["", " ", "one", "One", "a b c d", "a b c d e", "a b c d e f", "A  b\tc d e", "q " * 300, "q " * 7])]
    docs += [(4000 + k, docs[k % 7][1].upper()) for k in range(9)]
    rng.shuffle(docs)
    found = rows(jaccard_join(spark.createDataFrame(docs, SCHEMA), p))
    assert found == brute(docs, p.words, p.percent)
    assert sum(r[4] for r in found) > 100


def test_one_large_group_in_many_blocks(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    docs = family(rng, base, 150, 5, 10) + family(rng, [*base[:150], *(f"v{k}" for k in range(50))], 40, 3, 1000)
    df = spark.createDataFrame(docs, SCHEMA)
    want = brute(docs)
    for p in (JaccardJoin(), JaccardJoin(block=16), JaccardJoin(block_bytes=2000)):
        assert rows(jaccard_join(df, p)) == want


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, node string, grp string, size string, token string, n_links string, part string"
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    data = [(1, a), (1, a + " more"), (1, b), (2, b), (2, b), (None, a), (None, None), (3, None), (3, ""), (4, "one two"), (5, "One two"), (6, " ".join(f"l{k}" for k in range(60_000))), (7, " ".join(f"l{k}" for k in range(59_990)))]
    df = spark.createDataFrame([(*d, *"abcdef") for d in data], schema)
    got = jaccard_join(df).collect()
    assert sorted((r.n_shingles, -1 if r.n_links is None else r.n_links) for r in got) == sorted((n, -1 if k is None else k) for _, n, _, _, k in brute(data))
    by = sorted(((r.doc_id, r.n_shingles, r.component_id, r.class_id, r.n_links) for r in got), key=str)
    want = [(1, 36, 1, 1, 1), (1, 37, 1, 1, 1), (1, 36, 1, 1, 2), (2, 36, 1, 1, 2), (2, 36, 1, 1, 2), (None, 36, None, None, None), (None, 0, None, None, None), (3, 0, 3, 3, 0), (3, 0, 3, 3, 0), (4, 1, 4, 4, 1), (5, 1, 4, 4, 1), (6, 59_996, 6, 6, 1), (7, 59_986, 6, 7, 1)]
    assert by == sorted(want, key=str)
    assert jaccard_join(df.limit(0)).count() == 0
    assert rows(jaccard_join(spark.createDataFrame([(9, None), (8, "")], SCHEMA))) == [(8, 0, 8, 8, 0), (9, 0, 9, 9, 0)]


def test_bounds():
    rng = random.Random(1)
    for _ in range(2000):
        n, m = rng.randrange(1, 200), rng.randrange(1, 200)
        need = int(least_common(np.array(n), np.array(m), 80))
        assert all((100 * c >= 80 * (n + m - c)) == (c >= need) for c in range(min(n, m) + 1))
    x, y = np.array([1, 4, 6], np.uint64), np.array([4, 9], np.uint64)
    assert _without(x, y).tolist() == [1, 6] and _without(y, x).tolist() == [9] and _without(x, x[:0]).tolist() == [1, 4, 6]
