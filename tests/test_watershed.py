"""Floods of whole images and of tiles against relaxing all pixels until nothing changes."""

import random

import pytest

from rastermill.operators import segmentation


def relaxed(level, marker):
    """{(r, c): label}, taking the least way of all neighbours again and again."""
    value = {p: (level[p], 0, m) for p, m in marker.items() if p in level}
    while True:
        new = {}
        for r, c in level:
            if (r, c) in marker:
                new[r, c] = value[r, c]
                continue
            v = level[r, c]
            ways = [(v, 0, w[2]) if v > w[0] else (w[0], w[1] + 1, w[2]) for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if (w := value.get(q))]
            if ways:
                new[r, c] = min(ways)
        if new == value:
            return {p: w[2] for p, w in value.items()}
        value = new


@pytest.fixture(scope="module")
def images():
    random.seed(6)
    out = {}
    for image in range(6):
        h, w, steps = random.randrange(5, 26), random.randrange(5, 26), random.choice([2, 4, 50])
        level = {(r, c): float(random.randrange(steps)) for r in range(h) for c in range(w) if random.random() < 0.85}
        marker = {p: f"s{random.randrange(5)}" for p in random.sample(sorted(level), random.randrange(1, 7))}
        out[image] = (level, marker)
    out[6] = ({(0, c): 0.0 for c in range(9)} | {(3, 3): 1.0}, {(0, 0): "a", (0, 8): "b"})
    out[7] = ({(0, 0): 1.0}, {})
    return out


@pytest.mark.parametrize("most,tile", [(1 << 20, 512), (60, 4), (0, 7)])
def test_whole_images_and_tiles(spark, images, monkeypatch, most, tile):
    monkeypatch.setattr(segmentation, "MOST_FLOODED", most)
    monkeypatch.setattr(segmentation, "TILE", tile)
    levels = spark.createDataFrame([(i, r, c, v) for i, (level, _) in images.items() for (r, c), v in level.items()], "image_id long, r int, c int, v double")
    markers = spark.createDataFrame([(i, r, c, s) for i, (_, marker) in images.items() for (r, c), s in marker.items()], "image_id long, r int, c int, segment string")
    got = {(x.image_id, x.r, x.c): x.segment for x in segmentation.watershed(levels, levels, markers).collect()}
    assert got == {(i, *p): s for i, (level, marker) in images.items() for p, s in relaxed(level, marker).items()}
    assert got[6, 0, 4] == "a" and (6, 3, 3) not in got  # the middle is as far from both, and nothing leads to the far pixel
    assert segmentation.watershed(levels.limit(0), levels, markers).count() == 0
    assert segmentation.watershed(levels, levels, markers.limit(0)).count() == 0


def test_numbered_markers_and_repeated_pixels(spark):
    levels = spark.createDataFrame([(1, 0, c, abs(c - 4.0) * -1) for c in range(9)] * 2, "image_id int, r int, c int, v double").distinct()
    markers = spark.createDataFrame([(1, 0, 1, 7), (1, 0, 7, 3)], "image_id int, r int, c int, segment int")
    got = {x.c: x.segment for x in segmentation.watershed(levels.unionByName(levels), levels, markers).collect()}
    assert got == {c: "7" if c < 4 else "3" for c in range(9)} | {4: got[4]} and got[4] in "37"
