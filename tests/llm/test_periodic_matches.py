"""op8 over texts that repeat few words: all maximal matches, with and without the lookup, in bounded memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from rastermill.llm import decontamination as dc
from rastermill.llm.words import ALNUM, split_words, text_bytes


def words_of(texts):
    return split_words(*text_bytes(pa.array(texts, pa.string())), ALNUM, True)


def plain(texts, items, width):
    """Every (text, item, item_first, first, words) by comparing all places."""
    out = []
    for t, text in enumerate(texts):
        a = (text or "").split()
        for i, item in enumerate(items):
            b = (item or "").split()
            need = min(width, len(b))
            for s in range(len(b)):
                for h in range(len(a)):
                    if s and h and a[h - 1] == b[s - 1]:
                        continue
                    n = 0
                    while s + n < len(b) and h + n < len(a) and a[h + n] == b[s + n]:
                        n += 1
                    if need and n >= need:
                        out.append((t, i, s, h, n))
    return sorted(out)


def test_all_maximal_matches():
    draw = random.Random(7)
    for width in (1, 3, 10):
        for alphabet in ("a", "ab", "abcd"):
            texts = [" ".join(draw.choices(alphabet, k=draw.randrange(60))) for _ in range(5)] + [None, "", "a " * 40, "a b " * 20]
            items = [" ".join(draw.choices(alphabet, k=draw.randrange(25))) for _ in range(4)] + [None, "", "a", "a " * 30, "b a " * 9, "z a a a", "a a a z"]
            q = dc.Queries.of([str(k) for k in range(len(items))], items, width)
            wanted = plain(texts, items, width)
            for lookup in (True, False):
                assert sorted(map(tuple, dc.shard_matches(words_of(texts), q, lookup).tolist())) == wanted, (width, alphabet, lookup)


def test_one_word_over_and_over():
    """Pairs of suffix and place (4 * 10^7) aren't listed."""
    n, m = 200_000, 200
    words, q = words_of(["a " * n]), dc.Queries.of(["i"], ["a " * m], 10)
    tracemalloc.start()
    found = dc.shard_matches(words, q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    # each place against the item's first word, and each later suffix against the text's first
    assert len(found) == (n - 9) + (m - 10)
    assert found[:, 4].max() == m and np.count_nonzero(found[:, 4] == m) == n - m + 1


def test_no_words():
    q = dc.Queries.of(["i", "j"], ["a b c", None], 2)
    for texts in ([None], [""], ["..."]):
        for lookup in (True, False):
            assert len(dc.shard_matches(words_of(texts), q, lookup)) == 0
    assert len(dc.shard_matches(words_of(["a b"]), dc.Queries.of([], [], 2), False)) == 0
