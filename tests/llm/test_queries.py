"""Each registered query over its whole small tables against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pytest

import __spark_entry__
from rastermill.llm import queries as llm_queries
from rastermill.llm.license_scan import PHRASES
from tests.llm.brute import SPACED, contamination, counts, crc, lower, phrases, targets


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def result(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir).collect()


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_op2_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = result(spark, sf_dir, "op2_text_tag_ratio")
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op3_targets_and_totals(spark, sf_dir, documents):
    sizes = Counter()
    for d in documents.values():
        sizes[d.source] += len(SPACED.findall(d.text or ""))
    want, taken, largest = targets(sizes), Counter(), Counter()
    first = result(spark, sf_dir, "op3_pivotal_mixing")
    for r in first:
        s = documents[r.doc_id].source
        assert r.size == len(SPACED.findall(documents[r.doc_id].text or "")) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert len(first) == len(documents) and all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert sorted(first) == sorted(result(spark, sf_dir, "op3_pivotal_mixing"))


def test_op4_held_out_accuracy(spark, documents):
    sf = "/root/testdata/sf0.01"  # enough labels to hold some out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = result(spark, sf, "op4_fourier_ridge")
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score >= 0.5) == (labels[r.doc_id] == 1) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(held) / len(held) >= 0.93


def test_op5_round_trip(spark, sf_dir, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, start = {r.doc_id: r for r in result(spark, sf_dir, "op5_token_files")}, 0
    assert rows.keys() == documents.keys()
    for i in sorted(documents):
        ids = tokenizer.encode(documents[i].text or "", add_special_tokens=False).ids + [2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6_exact_base_and_a_better_model(spark, sf_dir, documents):
    words = {i: [*SPACED.findall(lower(d.text)), None] for i, d in documents.items()}
    c = Counter(w for i in words if crc(i) % 7 != 2 for w in words[i])
    n, v = sum(c.values()), len(c)
    rows = result(spark, sf_dir, "op6_bloom_language_model")
    assert len(rows) == len(documents)
    for r in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(words[r.doc_id]), sum(c[w] > 0 for w in words[r.doc_id]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op7_counts(spark, sf_dir, documents):
    rows = result(spark, sf_dir, "op7_perplexity_rules")
    assert len(rows) == len(documents)
    for r in rows:
        want = counts(documents[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    passed = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in passed) > 0.85 * len(passed)


def test_op8_hits(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = result(spark, sf_dir, "op8_suffix_arrays")
    assert len(rows) == len(documents) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = contamination(documents[r.doc_id].text, items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_op9_phrases(spark, sf_dir, documents):
    rows = result(spark, sf_dir, "op9_license_automaton")
    assert len(rows) == len(documents) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrases(documents[r.doc_id].text, PHRASES)
        assert {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")} and 0 <= r.score <= 1


def test_op10_places(spark, sf_dir, documents):
    rows = result(spark, sf_dir, "op10_sampled_splitters")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    total, largest = Counter(), 0
    for r in rows:
        raw = (documents[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r.shard] += r.size
        largest = max(largest, r.size)
    mean = sum(total.values()) / 16
    assert set(total) == set(range(16)) and all(abs(x - mean) <= largest for x in total.values())
    for shard in total:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql()) & set(llm_queries.ORACLE_SQL)))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(llm_queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.project(", ".join(columns)).fetchall())
