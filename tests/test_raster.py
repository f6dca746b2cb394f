import sys

import numpy as np
import pytest

from seamline.functions import raster


def brute_labels(mask, diagonal):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if diagonal:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    labels, count = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        count += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            inside = 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1]
            if inside and mask[a, b] and not labels[a, b]:
                labels[a, b] = count
                todo += [(a + dy, b + dx) for dy, dx in steps]
    return labels, count


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("seed", range(12))
def test_label_matches_flood_fill(seed, diagonal):
    mask = np.random.default_rng(seed).random((17, 23)) < 0.25 + 0.04 * seed
    labels, count = raster.label(mask, diagonal)
    expected, wanted = brute_labels(mask, diagonal)
    assert count == wanted
    assert (labels == expected).all()


def test_label_of_nothing():
    labels, count = raster.label(np.zeros((3, 4), bool), True)
    assert count == 0 and not labels.any()


@pytest.mark.parametrize("size", [3, 5, 7, 13])
@pytest.mark.parametrize("seed", range(3))
def test_morphology_matches_windows(seed, size):
    mask = np.random.default_rng(seed).random((15, 19)) < 0.4
    reach = size // 2
    for y in range(15):
        for x in range(19):
            window = mask[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
            assert raster.dilate(mask, size)[y, x] == window.any()
            assert raster.erode(mask, size)[y, x] == window.all()
        if seed:
            break


def test_closing_twice_is_two_dilations_then_two_erosions():
    mask = np.random.default_rng(5).random((30, 30)) < 0.1
    twice = raster.dilate(raster.dilate(mask, 7), 7)
    assert (raster.closed(mask, 7, 2) == raster.erode(raster.erode(twice, 7), 7)).all()


def test_rectangle_area_is_that_of_its_outline():
    mask = np.zeros((12, 12), bool)
    mask[3:7, 2:7] = True
    labels, areas = raster.outlines(mask)
    assert list(areas) == [12.0]
    assert (labels == 1).sum() == 20


def test_areas_of_plus_line_and_diagonal_pair():
    mask = np.zeros((9, 20), bool)
    mask[2, 1:4] = mask[1:4, 2] = True  # plus: diamond of area 2
    mask[2, 6:12] = True  # line: no area
    mask[1:3, 14:16] = mask[3:5, 16:18] = True  # two squares touching at a corner
    assert sorted(raster.outlines(mask)[1]) == [0.0, 2.0, 2.0]


def test_ring_is_filled():
    mask = np.zeros((9, 9), bool)
    mask[1:8, 1:8] = True
    mask[3:6, 3:6] = False
    labels, areas = raster.outlines(mask)
    assert list(areas) == [36.0]
    assert (labels == 1).sum() == 49


def test_part_inside_a_ring_belongs_to_it():
    mask = np.zeros((11, 11), bool)
    mask[1:10, 1:10] = True
    mask[2:9, 2:9] = False
    mask[5, 5] = True
    assert len(raster.outlines(mask)[1]) == 1


def test_edge_distance_matches_brute_force():
    mask = np.random.default_rng(3).random((14, 18)) < 0.9
    ys, xs = np.nonzero(mask)
    oy, ox = np.nonzero(~mask)
    expected = np.sqrt(((ys[:, None] - oy) ** 2 + (xs[:, None] - ox) ** 2).min(axis=1))
    assert np.allclose(raster.edge_distance(raster.column_gaps(mask), ys, xs), expected)


def test_edge_distance_without_edge():
    assert list(raster.edge_distance(raster.column_gaps(np.ones((4, 5), bool)), np.array([1]), np.array([2]))) == [9.0]


def test_resizers():
    ramp = np.arange(8.0)[None, :].repeat(4, axis=0)
    assert np.allclose(raster.resize(ramp, 4, 4, "area")[0], [0.5, 2.5, 4.5, 6.5])
    assert np.allclose(raster.resize(ramp, 4, 16, "linear")[0, :4], [0, 0.25, 0.75, 1.25])
    inner = raster.resize(ramp, 4, 16, "cubic")[0, 6:10]
    assert np.allclose(np.diff(inner), 0.5, atol=0.1)
    flat = np.full((5, 7, 3), 9.0)
    for kind in ("area", "linear", "cubic", "smooth"):
        assert np.allclose(raster.resize(flat, 11, 3, kind), 9.0)


def test_blur_of_flat_and_point():
    assert (raster.blur(np.full((30, 30), 77, np.uint8)) == 77).all()
    point = np.zeros((41, 41), np.uint8)
    point[20, 20] = 255
    blurred = raster.blur(point)
    assert blurred[20, 20] == blurred.max() and (blurred == blurred.T).all()


def test_majority_is_the_median():
    mask = np.random.default_rng(1).random((12, 13)) < 0.5
    padded = np.pad(mask, 2, mode="edge")
    expected = [[np.median(padded[y : y + 5, x : x + 5]) for x in range(13)] for y in range(12)]
    assert (raster.majority(mask, 5) == np.array(expected).astype(bool)).all()


def test_gray_and_saturation():
    pixel = np.array([[[255, 0, 0], [10, 10, 10], [0, 0, 0], [200, 100, 50]]], np.uint8)
    assert list(raster.gray(pixel)[0]) == [76, 10, 0, 124]
    assert list(raster.saturation(pixel)[0]) == [255, 0, 0, 191]


def test_extents_of_the_visible_part():
    image = np.zeros((100, 80, 4), np.uint8)
    image[20:70, 30:60] = (10, 20, 30, 255)
    assert raster.extents(image, 0.04) == [(18, 72), (28, 62)]  # 50 x 30 and 2 pixels of margin on each side
    assert raster.extents(image[:, :, :3]) == [(0, 100), (0, 80)]
    with pytest.raises(ValueError):
        raster.extents(np.full((4, 4, 4), 10, np.uint8))


def test_laid_without_scaling():
    image = np.zeros((100, 80, 4), np.uint8)
    image[20:70, 30:60] = (10, 20, 30, 255)
    same = [np.eye(n) for n in (100, 80)]
    flat = raster.lay(image, *same, 205)
    assert tuple(flat[0, 0]) == (205, 205, 205) and tuple(flat[30, 40]) == (10, 20, 30)
    half = np.full((1, 1, 4), 101, np.uint8)
    half[..., 3] = 128
    assert raster.lay(half, np.eye(1), np.eye(1), 205)[0, 0, 0] == int(101 * (128 / 255) + 205 * (1 - 128 / 255))


def test_boxed_and_squared():
    wide = np.full((10, 40, 3), 7, np.uint8)
    boxed = raster.boxed(wide, 20)
    assert boxed.shape == (20, 20, 3)
    assert (boxed[:7] == 205).all() and (boxed[7:12] == 7).all() and (boxed[12:] == 205).all()
    grown = raster.boxed(wide, 80)
    assert (grown[:30] == 205).all() and (grown[30:50] == 7).all() and (grown[50:] == 205).all()
    squared = raster.squared(wide, 40)
    assert squared.shape == (40, 40, 3) and np.allclose(squared[15:25], 7) and np.allclose(squared[:15], 220)


def test_garment_mask():
    image = np.full((40, 40, 3), 205, np.uint8)
    assert raster.garment_mask(image).all()  # nothing found: everything
    image[10:30, 10:30] = 213  # at the tolerance, not above it
    assert raster.garment_mask(image).all()
    image[10:30, 10:30] = 214
    image[2:5, 36:39] = 0
    image[18:22, 18:22] = 205
    mask = raster.garment_mask(image)
    assert mask[10:30, 10:30].all() and mask.sum() == 400


@pytest.mark.parametrize(
    "orientation, expected",
    [
        (1, [[1, 2, 3], [4, 5, 6]]),
        (2, [[3, 2, 1], [6, 5, 4]]),
        (3, [[6, 5, 4], [3, 2, 1]]),
        (4, [[4, 5, 6], [1, 2, 3]]),
        (5, [[1, 4], [2, 5], [3, 6]]),
        (6, [[4, 1], [5, 2], [6, 3]]),
        (7, [[6, 3], [5, 2], [4, 1]]),
        (8, [[3, 6], [2, 5], [1, 4]]),
    ],
)
def test_orientation(orientation, expected):
    pixels = np.array([[1, 2, 3], [4, 5, 6]])
    assert raster.upright(pixels, orientation).tolist() == expected


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("kind", ["noise", "comb", "spiral"])
def test_label_of_many_runs_takes_few_steps(kind, diagonal):
    """Nothing is called once for each run."""
    side = 160 if kind == "noise" else 60
    mask = np.random.default_rng(1).random((side, side)) < 0.5
    if kind == "comb":
        mask = np.arange(side) % 2 + np.zeros((side, 1)) == 0
        mask[-1] = True
    if kind == "spiral":
        ring = np.minimum.reduce(np.meshgrid(np.minimum(np.arange(side), side - 1 - np.arange(side)), np.minimum(np.arange(side), side - 1 - np.arange(side))))
        mask = ring % 2 == 0
        mask[np.arange(1, side // 2, 2) + 1, np.arange(1, side // 2, 2)] = True
    called = []
    sys.settrace(lambda frame, event, arg: called.append(frame.f_code.co_name) if frame.f_code.co_filename == raster.__file__ else None)
    try:
        labels, count = raster.label(mask, diagonal)
    finally:
        sys.settrace(None)
    assert called == ["label"]
    expected, number = brute_labels(mask, diagonal)
    assert count == number and (labels == expected).all()
