"""Morphology by spans and tiles, and distances, against plain loops."""

import numpy as np
import pytest

from rastermill.operators import neighbourhood as nb

SIZES = {"a": (23, 31), "b": (1, 9), "c": (150, 140), "d": (12, 12), "e": (4, 5)}


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(5)
    masks = {k: rng.random(s) < 0.8 for k, s in SIZES.items()}
    masks["d"][:] = True
    masks["e"][:] = False
    masks["c"][20:120, 10:130] = True
    grey = {k: rng.integers(0, 50, s) for k, s in SIZES.items()}
    images = spark.createDataFrame([(k, *s) for k, s in SIZES.items()], "image_id string, height int, width int")
    mask = spark.createDataFrame([(k, int(r), int(c)) for k, m in masks.items() for r, c in np.argwhere(m)], "image_id string, r int, c int")
    pixels = spark.createDataFrame([(k, r, c, float(g[r, c])) for k, g in grey.items() for r in range(g.shape[0]) for c in range(g.shape[1])], "image_id string, r int, c int, v double")
    return masks, grey, images, mask, pixels


def around(a, offsets, pick):
    """pick of a over the offsets inside the image."""
    h, w = a.shape
    out = None
    for dr, dc in offsets:
        x = np.full((h, w), np.nan)
        r0, r1, c0, c1 = max(0, -dr), min(h, h - dr), max(0, -dc), min(w, w - dc)
        if r0 < r1 and c0 < c1:
            x[r0:r1, c0:c1] = a[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
        out = x if out is None else pick(out, x)
    return out


def places(rows):
    return sorted((r.image_id, r.r, r.c) for r in rows.collect())


@pytest.mark.parametrize("scatter", [0, 10**6])
@pytest.mark.parametrize("n", [0, 1, 4])
def test_masks_by_spans_and_by_copies(cases, monkeypatch, n, scatter):
    masks, _, images, mask, _ = cases
    monkeypatch.setattr(nb, "SCATTER_PLACES", scatter)
    grow = lambda m: around(m.astype(float), nb.disk(n), np.fmax) > 0
    shrink = lambda m: around(m.astype(float), nb.disk(n), np.fmin) > 0
    wanted = {nb.dilate: grow, nb.erode: shrink, nb.opening: lambda m: grow(shrink(m)), nb.closing: lambda m: shrink(grow(m))}
    for ours, plain in wanted.items():
        assert places(ours(mask, images, n)) == sorted((k, int(r), int(c)) for k, m in masks.items() for r, c in np.argwhere(plain(m)))


@pytest.mark.parametrize("scatter", [0, 10**6])
@pytest.mark.parametrize("n", [1, 4])
def test_grey_by_tiles_and_by_copies(cases, monkeypatch, n, scatter):
    _, grey, images, _, pixels = cases
    monkeypatch.setattr(nb, "SCATTER_PLACES", scatter)
    for ours, pick in ((nb.gray_erode, np.fmin), (nb.gray_dilate, np.fmax)):
        wanted = {k: around(g.astype(float), nb.disk(n), pick) for k, g in grey.items()}
        got = sorted(map(tuple, ours(pixels, images, n).select("image_id", "r", "c", "v").collect()))
        assert got == sorted((k, r, c, w[r, c]) for k, w in wanted.items() for r in range(w.shape[0]) for c in range(w.shape[1]))
    square = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1)]
    tops = {k: around(g.astype(float), square, np.fmax) for k, g in grey.items()}
    assert places(nb.local_maxima(pixels, images, n)) == sorted((k, int(r), int(c)) for k, g in grey.items() for r, c in np.argwhere((g == tops[k]) & (g > g.min())))


def test_partial_pixels_in_tiles(spark, monkeypatch):
    """Pixels across tile borders, some missing, whole numbers."""
    images = spark.createDataFrame([(1, 300, 300)], "image_id long, height int, width int")
    pixels = spark.createDataFrame([(1, 127, 128, 5), (1, 128, 127, 9), (1, 128, 127, 7), (1, 0, 299, 3), (1, 60, 60, None)], "image_id long, r long, c long, v long")
    out = []
    for scatter in (0, 10**6):
        monkeypatch.setattr(nb, "SCATTER_PLACES", scatter)
        out.append(nb.gray_dilate(pixels.where("v is not null"), images, 3).select("image_id", "r", "c", "v"))
    assert out[0].dtypes == out[1].dtypes and sorted(map(tuple, out[0].collect())) == sorted(map(tuple, out[1].collect()))


def test_least_parabola():
    rng = np.random.default_rng(2)
    for n in [*range(1, 40), 257]:
        for share in (0.0, 0.1, 0.9):
            g = np.where(rng.random(n) < share, -1, rng.integers(0, 12, n))
            g = np.full(n, -1) if share == 0.1 and n % 5 == 0 else g
            k = np.flatnonzero(g >= 0)
            wanted = [min(((c - k) ** 2 + g[k] ** 2), default=-1) for c in range(n)]
            assert nb._least_parabola(g).tolist() == wanted


def test_distances(cases):
    masks, _, images, mask, _ = cases
    got = {(r.image_id, r.r, r.c): r.d2 for r in nb.squared_distances(mask, images).where("image_id in ('a', 'b', 'd')").collect()}
    for k in "ab":
        off = np.argwhere(~masks[k])
        for r, c in np.argwhere(masks[k]):
            assert got[k, r, c] == ((off - (r, c)) ** 2).sum(1).min()
    assert got["d", 0, 0] is None
