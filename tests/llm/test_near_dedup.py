import random

from tests.llm.brute import components
from rastermill.llm.near_dedup import NearDedup, least_agreement, near_duplicates, op1_near_duplicates


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def check(df, docs, words=4):
    want = components(docs, words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def test_whole_table_matches_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op1_near_duplicates(spark, sf_dir), docs)


def test_chains_copies_and_edges(spark):
    random.seed(1)
    base = [f"w{random.randrange(400)}" for _ in range(300)]
    docs = [(100, " ".join(base)), (7, " ".join(base)), (101, " ".join(base).upper())]
    for k in range(12):  # each step changes a few words: neighbours link, ends don't
        base = base.copy()
        for _ in range(3):
            base[random.randrange(300)] = f"x{k}{random.random()}"
        docs.append((200 + k, " ".join(base)))
    docs += [(1, ""), (2, None), (3, "   \n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (8, "ü é ß ñ ü é ß ñ"), (9, "a b c d e")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(near_duplicates(df, NearDedup(words=4)), docs)


def test_copies_around_a_base_that_only_link_to_it(spark):
    random.seed(5)
    base = [f"b{k}" for k in range(400)]
    docs = [(500, " ".join(base))]
    for k in range(60):
        copy = base.copy()
        for at in random.sample(range(400), 9):
            copy[at] = f"y{k}-{at}"
        docs.append((k, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(near_duplicates(df, NearDedup(words=4)), docs)
    check(near_duplicates(df, NearDedup(words=4, block=16)), docs)


def test_empty_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, node long, component string, sig string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    data = [(None, "a b c d e f g", 1, "x", "y"), (3, "a b c d e f g", 1, "x", "y"), (3, "a b c d e f g", 1, "x", "y"), (2, None, 1, "x", "y")]
    got = rows(near_duplicates(spark.createDataFrame(data, schema)))
    assert got == sorted([(None, 3, None, False), (3, 3, 3, True), (3, 3, 3, True), (2, 0, 2, True)], key=str)


def test_posterior_bound_rises_with_what_is_seen():
    bounds = [least_agreement(n, 80, 1e-6) for n in (16, 32, 64, 128)]
    assert bounds == sorted(bounds) and bounds[-1] < 0.8 * 128


def test_ids_that_stand_for_several_texts(spark):
    """Each row is linked by its own text, whatever other rows of its id say."""
    random.seed(7)
    text = [" ".join(f"{c}{random.randrange(10_000)}" for _ in range(60)) for c in "abcd"]
    docs = [(5, text[0]), (5, text[1]), (6, text[0] + " more"), (7, text[1]), (8, text[2]), (5, text[0]), (None, text[3]), (9, None), (9, "")]
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(found) == len(docs)
    by = {}
    for r in found:
        by.setdefault(r.component, []).append((r.doc_id, r.component_id))
    groups = sorted((sorted(i for i, _ in rows if i is not None), {c for _, c in rows}) for k, rows in by.items() if k is not None)
    assert groups == [([5, 5, 6], {5}), ([5, 7], {5}), ([8], {8}), ([9], {9}), ([9], {9})]


def test_families_around_one_boilerplate(spark):
    """All meet in some buckets, links are within families only."""
    random.seed(11)
    shared = [f"s{k}" for k in range(220)]
    docs = []
    for family in range(6):
        own = [f"f{family}-{k}" for k in range(70)]
        for k in range(8):
            copy = own.copy()
            for at in random.sample(range(70), 3):
                copy[at] = f"z{family}-{k}-{at}"
            docs.append((100 * family + k, " ".join([*shared, *copy])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (4, 1024):
        check(near_duplicates(df, NearDedup(words=4, block=block)), docs)
