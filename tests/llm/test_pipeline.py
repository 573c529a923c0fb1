"""Stages of the pipeline, each on its own input, against plain Python."""

from collections import Counter

import corpus_pipeline
from tests.llm.brute import components, contamination, counts


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns and not as_rows(good) - as_rows(docs)
    for r in good.collect():
        c = counts(r.text)
        assert c[0] >= 50 and 100 * c[4] <= 50 * c[0]

    one = steps["near-dedup"](spark, docs, sf_dir)
    whole = components([(r.doc_id, r.text) for r in docs.collect()], words=5)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in whole.values()})

    clean = steps["decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.collect() if not contamination(r.text, items)[1])

    mixed = steps["mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and set(as_rows(mixed)) <= set(as_rows(docs)) and max(as_rows(mixed).values()) <= 3


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "token output"]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and min(r.start for r in rows) == 0
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_stages_survive_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, row string"
    long = " ".join(f"word{k}" for k in range(30_000))
    odd = [(1, None, None, None, None, "x", "y"), (1, "", "en", "a", 0, "x", "y"), (None, long, "en", "a", 5, "x", "y"), (2, long, None, None, 5, "x", "y"), (2, long, None, None, 5, "x", "y")]
    for data in ([], odd):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert not set(as_rows(out)) - set(as_rows(docs)), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(data)


def test_near_dedup_keeps_other_texts_of_a_repeated_id(spark, sf_dir):
    own, other = (" ".join(f"{c}{k}" for k in range(80)) for c in "xy")
    docs = spark.createDataFrame([(1, own, "en"), (2, own + " z", "en"), (2, other, "en"), (3, other, "en"), (2, other, "en")], "doc_id long, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, sf_dir)
    assert sorted(map(tuple, kept.collect())) == [(1, own, "en"), (2, other, "en")]
