"""Questions of many pieces of text to one part of the filter."""

import numpy as np
import pyarrow as pa

from rastermill.llm import lm_scoring


def _rows(kind, segment, side, keys, bits, piece):
    n = len(keys)
    blobs = pa.array([k.tobytes() for k in keys], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array([side] * n, pa.int32()), blobs, pa.array(bits, pa.int64()), pa.array(piece, pa.int64())], names=["kind", "segment", "side", "keys", "bits", "piece"])


def test_pieces_are_looked_up_together(monkeypatch):
    calls, probe = [], lm_scoring._probe
    monkeypatch.setattr(lm_scoring, "_probe", lambda *a: calls.append(len(a[0])) or probe(*a))
    rng = np.random.default_rng(1)
    questions = {(s, p): rng.integers(0, 1 << 62, 5 + p % 3).astype(np.uint64) for s in (3, 4) for p in range(300)}
    data = rng.integers(0, 256, 1000).astype(np.uint8)
    batches = [b for s in (3, 4) for b in (_rows(1, s, 0, [data], [8000], [None]), _rows(1, s, 1, [questions[s, p] for p in range(300)], [None] * 300, range(300)))]
    found = pa.Table.from_batches(list(lm_scoring._answer(5)(iter(batches)))).to_pylist()
    assert len(calls) == 2 and len(found) == 600
    for x in found:
        key = questions[x["segment"], x["piece"]]
        want = probe(key, np.full(len(key), 8000, np.uint64), np.zeros(len(key), np.int64), data, 5)
        assert x["kind"] == 1 and x["levels"] == want.tobytes()


def test_rare_words_are_looked_up_together():
    counts = (np.arange(1, 50, dtype=np.uint64), np.arange(1, 50, dtype=np.int64))
    blob = lambda *x: [pa.array([v.tobytes()], pa.binary()) for v in x]
    row = lambda side, keys, second, rows: pa.RecordBatch.from_arrays([pa.array([7], pa.int32()), pa.array([side], pa.int32()), *blob(keys, second, rows)], names=["segment", "side", "keys", "counts", "row_ids"])
    asked = [row(1, np.array([k + 1], np.uint64), np.array([2], np.uint32), np.array([k % 5], np.int64)) for k in range(100)]
    out = list(lm_scoring._look_up(iter([row(0, *counts, np.zeros(0, np.int64)), *asked])))
    assert len(out) == 1
    found = {x["row_id"]: (round(x["more_logs"], 9), x["more_known"]) for x in out[0].to_pylist()}
    known = lambda r: [k + 1 for k in range(49) if k % 5 == r]
    assert found == {r: (round(sum(2 * np.log10(c + 1) for c in known(r)), 9), 2 * len(known(r))) for r in range(5)}
