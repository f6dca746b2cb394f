"""Pixel arithmetic used inside tasks, one bounded image at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# --- fixed values -----------------------------------------------------------------------------
CANVAS_GRAY, IDENTITY_GRAY = 205, 220
GRAY_WEIGHTS = np.array([0.299, 0.587, 0.114])
CUBIC_A = -0.75
# --- end of fixed values ----------------------------------------------------------------------


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark image bytes (gray, BGR or BGRA) as RGB or RGBA."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, [2, 1, 0, 3][:channels]]


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Undo a camera orientation tag (1 to 8)."""
    if orientation in (2, 4, 5, 7):
        pixels = pixels[:, ::-1]
    turns = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    return np.rot90(pixels, turns)


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[:, :, :3] @ GRAY_WEIGHTS).astype(np.uint8)


def saturation(rgb: np.ndarray) -> np.ndarray:
    red, green, blue = (rgb[:, :, c] for c in range(3))
    high = np.maximum(np.maximum(red, green), blue).astype(np.float64)
    spread = high - np.minimum(np.minimum(red, green), blue)
    return np.rint(np.divide(255 * spread, high, out=np.zeros_like(high), where=high > 0)).astype(np.uint8)


@lru_cache(maxsize=256)
def resize_weights(size: int, target: int, kind: str) -> np.ndarray:
    """Weights [target, size] of one axis: ``linear`` and ``cubic`` sample, ``area`` averages,
    ``smooth`` is linear widened by the shrink factor."""
    scale = size / target
    out = np.arange(target)[:, None]
    at = np.arange(size)[None, :]
    if kind == "area":
        low, high = out * scale, (out + 1) * scale
        weights = np.clip(np.minimum(at + 1, high) - np.maximum(at, low), 0, None)
        return weights / weights.sum(axis=1, keepdims=True)
    center = (out + 0.5) * scale - 0.5
    if kind == "smooth":
        weights = np.clip(1 - np.abs(at - center) / max(scale, 1.0), 0, None)
        return weights / weights.sum(axis=1, keepdims=True)
    weights = np.zeros((target, size))
    first = np.floor(center[:, 0]).astype(int)
    reach = range(0, 2) if kind == "linear" else range(-1, 3)
    for step in reach:
        x = np.abs(center[:, 0] - (first + step))
        if kind == "linear":
            w = 1 - x
        else:
            near = (CUBIC_A + 2) * x**3 - (CUBIC_A + 3) * x**2 + 1
            far = CUBIC_A * (x**3 - 5 * x**2 + 8 * x - 4)
            w = np.where(x <= 1, near, far)
        np.add.at(weights, (np.arange(target), np.clip(first + step, 0, size - 1)), w)
    return weights


def resize(values: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    rows = resize_weights(values.shape[0], height, kind)
    columns = resize_weights(values.shape[1], width, kind)
    return np.moveaxis(np.tensordot(rows, np.tensordot(values, columns, (1, 1)), (1, 0)), -1, 1)


def _sliding(mask: np.ndarray, size: int, fold, outside: bool) -> np.ndarray:
    """``fold`` over a square window, by doubling the span already covered."""
    reach = size // 2
    wide = np.full((mask.shape[0] + 2 * reach, mask.shape[1] + 2 * reach), outside)
    wide[reach : reach + mask.shape[0], reach : reach + mask.shape[1]] = mask
    span = 1
    while span < size:
        step = min(span, size - span)
        wide = fold(wide[:-step], wide[step:])
        wide = fold(wide[:, :-step], wide[:, step:])
        span += step
    return wide


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    return _sliding(mask, size, np.logical_or, False)


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    return _sliding(mask, size, np.logical_and, True)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(mask, size), size)


def closed(mask: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    wide = times * (size - 1) + 1
    return erode(dilate(mask, wide), wide)


def _weighted(values: np.ndarray, weights: np.ndarray, edge: str) -> np.ndarray:
    """Sum over a square window with separable weights."""
    height, width = values.shape
    padded = np.pad(values, len(weights) // 2, mode=edge)
    rows = weights[0] * padded[:height]
    part = np.empty_like(rows)
    for i, w in enumerate(weights[1:], start=1):
        rows += np.multiply(padded[i : i + height], w, out=part)
    done = weights[0] * rows[:, :width]
    part = np.empty_like(done)
    for i, w in enumerate(weights[1:], start=1):
        done += np.multiply(rows[:, i : i + width], w, out=part)
    return done


def majority(mask: np.ndarray, size: int) -> np.ndarray:
    """Median of a binary mask; edges are repeated outwards."""
    return 2 * _weighted(mask.astype(np.int32), np.ones(size, np.int32), "edge") > size * size


def blur(values: np.ndarray, size: int = 21, sigma: float | None = None) -> np.ndarray:
    """Gaussian blur of a gray image, mirrored at the edges without repeating them."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return np.rint(_weighted(values.astype(np.float64), weights / weights.sum(), "reflect")).astype(np.uint8)


def label(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Connected parts numbered from 1 in raster order of their first pixel.

    Works on horizontal runs: those that touch in two rows are pairs, and each run takes on the first run of its part.
    """
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    edges = np.diff(padded, axis=1).ravel()
    ys, starts = np.divmod(np.flatnonzero(edges == 1), width + 1)
    ends = np.flatnonzero(edges == -1) - ys * (width + 1)
    labels = np.zeros(mask.shape, np.int32)
    if not len(ys):
        return labels, 0
    # the runs of the row above that a run touches are neighbours in the list of runs
    reach, row = 1 if diagonal else 0, width + 4
    first = np.searchsorted(ys * row + ends, (ys - 1) * row + starts - reach, side="right")
    last = np.searchsorted(ys * row + starts, (ys - 1) * row + ends + reach, side="left")
    touching = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(ys)), touching)
    above = np.arange(len(below)) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(first, touching)
    parent = np.arange(len(ys))
    while True:
        a, b = parent[above], parent[below]
        apart = a != b
        if not apart.any():
            break
        above, below, a, b = above[apart], below[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        further = parent[parent]
        while (further != parent).any():
            parent, further = further, further[further]
    own = parent == np.arange(len(ys))
    numbers = np.cumsum(own)[parent]
    labels[np.asarray(mask, bool)] = np.repeat(numbers, ends - starts)
    return labels, int(own.sum())


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Add every background part that does not reach the border."""
    around = np.ones((mask.shape[0] + 2, mask.shape[1] + 2), bool)
    around[1:-1, 1:-1] = ~mask
    parts, count = label(around, diagonal=False)
    return mask.copy() if count == 1 else (parts != 1)[1:-1, 1:-1]


def contour_areas(labels: np.ndarray, count: int) -> np.ndarray:
    """Area inside the outline through the pixel centres, per filled part.

    Each window of 2 x 2 pixels contributes 1 when the part fills it and 1/2 with three pixels.
    """
    padded = np.pad(labels, 1)
    corners = np.stack([padded[:-1, :-1], padded[:-1, 1:], padded[1:, :-1], padded[1:, 1:]])
    owner = corners.max(axis=0)
    filled = (corners == owner).sum(axis=0)
    share = np.where(filled == 4, 1.0, np.where(filled == 3, 0.5, 0.0))
    return np.bincount(owner.ravel(), share.ravel(), minlength=count + 1)[1:]


def outlines(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filled outer parts of a mask as (labels, contour areas)."""
    filled = fill_holes(mask)
    labels, count = label(filled, diagonal=True)
    # parts do not touch: the set pixels of a window of 2 x 2 are of one part, and three of them hold a diagonal
    inside = filled.astype(np.uint8)
    rows = inside[:-1] + inside[1:]
    at = np.flatnonzero(rows[:, :-1] + rows[:, 1:] >= 3)
    ys, xs = np.divmod(at, max(1, mask.shape[1] - 1))
    owner = np.maximum(labels[ys, xs], labels[ys + 1, xs + 1])
    share = np.where((rows[ys, xs] + rows[ys, xs + 1]) == 4, 1.0, 0.5)
    return labels, np.bincount(owner, share, minlength=count + 1)[1:]


def garment_mask(rgb: np.ndarray, background: int = CANVAS_GRAY, tolerance: int = 8) -> np.ndarray:
    """The largest part that differs from the canvas, filled; everything when there is none."""
    colours = rgb[:, :, :3]
    other = (colours > background + tolerance) | (colours < background - tolerance)
    mask = other[:, :, 0] | other[:, :, 1] | other[:, :, 2]
    labels, areas = outlines(opened(closed(mask, 7, times=2), 3))
    return labels == areas.argmax() + 1 if len(areas) else np.ones(mask.shape, bool)


def column_gaps(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest one of its column outside the mask; at most height + width."""
    height, width = mask.shape
    far, rows = height + width, np.arange(height)[:, None]
    above = np.maximum.accumulate(np.where(mask, -far, rows), axis=0)
    below = np.minimum.accumulate(np.where(mask, height + far, rows)[::-1], axis=0)[::-1]
    return np.minimum(np.minimum(rows - above, below - rows), far)


def edge_distance(gaps: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Exact distance of the given pixels to the nearest pixel outside the mask with these gaps.

    Where the mask leaves nothing out, every distance is height + width.
    """
    squares = (xs[:, None] - np.arange(gaps.shape[1])) ** 2 + gaps[ys] ** 2
    return np.sqrt(squares.min(axis=1))


VISIBLE = 10


def extents(pixels: np.ndarray, margin: float = 0.0) -> list[tuple[int, int]]:
    """Rows and columns (start, stop) that hold anything visible, widened by a share of the longer one.

    Pictures without alpha are visible everywhere.
    """
    if pixels.shape[2] < 4:
        return [(0, n) for n in pixels.shape[:2]]
    shown = pixels[:, :, 3] > VISIBLE
    hits = [np.flatnonzero(shown.any(axis=1 - axis)) for axis in (0, 1)]
    if not len(hits[0]):
        raise ValueError("nothing in the picture is visible: its alpha is 0 everywhere")
    more = round(max(int(h[-1] - h[0]) + 1 for h in hits) * margin)
    return [(max(0, int(h[0]) - more), min(n, int(h[-1]) + 1 + more)) for h, n in zip(hits, pixels.shape, strict=False)]


def axis_weights(size: int, part: tuple[int, int], target: int, canvas: int, kind: str) -> np.ndarray:
    """Weights [canvas, size] that cut ``part`` out of an axis, scale it to ``target`` and lay it in the middle.

    Canvas places that nothing is laid on have no weight.
    """
    weights = np.zeros((canvas, size))
    at = (canvas - target) // 2
    weights[at : at + target, part[0] : part[1]] = resize_weights(part[1] - part[0], target, kind)
    return weights


LAY = "yh,hwc,xw->yxc"


@lru_cache(maxsize=256)
def _path(*shapes: tuple[int, ...]) -> list:
    """The order in which the two axes are scaled, which depends on the sizes only."""
    return np.einsum_path(LAY, *[np.empty(shape) for shape in shapes], optimize=True)[0]


def lay(pixels: np.ndarray, rows: np.ndarray, columns: np.ndarray, background: int) -> np.ndarray:
    """The picture on a gray canvas, through one weight matrix for each axis.

    All is reckoned from the background: transparency and canvas places without weight leave it as it is.
    Colours mixed by transparency lose their fractions before they are scaled.
    """
    ink = pixels[:, :, :3].astype(np.float32)
    if pixels.shape[2] == 4:
        cover = pixels[:, :, 3:].astype(np.float32) / np.float32(255)
        ink = np.floor(ink * cover + np.float32(background) * (1 - cover))
    raised = ink.astype(np.float64) - background
    path = _path(rows.shape, raised.shape, columns.shape)
    return np.einsum(LAY, rows, raised, columns, optimize=path) + background


@lru_cache(maxsize=256)
def axis_bands(size: int, target: int, kind: str, band: int) -> list[tuple[slice, slice, np.ndarray]]:
    """``resize_weights`` cut into some target places at a time, with the source places that have a weight for these."""
    weights, bands = resize_weights(size, target, kind), []
    for at in range(0, target, band):
        part = weights[at : at + band]
        used = np.flatnonzero(part.any(axis=0))
        source = slice(int(used[0]), int(used[-1]) + 1)
        bands.append((slice(at, at + len(part)), source, np.ascontiguousarray(part[:, source])))
    return bands


def _inked(pixels: np.ndarray, background: int) -> np.ndarray:
    """Planes of the colours, mixed with the background where they are transparent."""
    planes = np.moveaxis(pixels, 2, 0)
    ink, alpha = planes[:3], planes[3:]
    if not len(alpha):
        return ink
    if ((alpha == 0) | (alpha == 255)).all():
        return np.where(alpha, ink, np.uint8(background))
    ink, cover = ink.astype(np.float32), alpha.astype(np.float32) / np.float32(255)
    return np.floor(ink * cover + np.float32(background) * (1 - cover))


#: Sums in another order differ by far less than this.
TIE = 1e-7
BAND_ROWS, BAND_COLUMNS = 16, 32


def boxed(pixels: np.ndarray, size: int, background: int = CANVAS_GRAY, margin: float = 0.04) -> np.ndarray:
    """What is visible, as large as fits into a square canvas: averaged when it shrinks, cubic when it grows.

    A band of the canvas is reckoned at a time, from the places that have a weight for it. A picture with a sum that is
    a tie goes through ``lay`` as a whole, so that its rounding does not depend on the order of adding.
    """
    parts = extents(pixels, margin)
    scale = size / max(stop - start for start, stop in parts)
    height, width = (max(1, round((stop - start) * scale)) for start, stop in parts)
    kind = "area" if scale < 1 else "cubic"
    top, left = (size - height) // 2, (size - width) // 2
    ink = _inked(pixels[slice(*parts[0]), slice(*parts[1])], background)
    across = axis_bands(ink.shape[2], width, kind, BAND_COLUMNS)
    canvas = np.full((size, size, 3), background, np.uint8)
    laid = np.moveaxis(canvas[top : top + height, left : left + width], 2, 0)
    for rows, source, weights in axis_bands(ink.shape[1], height, kind, BAND_ROWS):
        raised = np.matmul(weights, np.subtract(ink[:, source], background, dtype=np.float64)).reshape(-1, ink.shape[2])
        values = np.empty((len(raised), width))
        for columns, places, shares in across:
            np.matmul(raised[:, places], shares.T, out=values[:, columns])
        values += background
        rounded = np.rint(values)
        values -= rounded
        if max(values.max(), -values.min()) > 0.5 - TIE:
            targets = zip(pixels.shape, parts, (height, width), strict=False)
            whole = lay(pixels, *[axis_weights(n, part, target, size, kind) for n, part, target in targets], background)
            return np.clip(np.rint(whole), 0, 255).astype(np.uint8)
        laid[:, rows] = np.clip(rounded, 0, 255, out=rounded).reshape(3, -1, width)
    return canvas


def squared(pixels: np.ndarray, side: int, background: int = IDENTITY_GRAY) -> np.ndarray:
    """The colours in the middle of a square, smoothly scaled to ``side``."""
    whole = resize_weights(max(pixels.shape[:2]), side, "smooth")
    axes = [whole[:, (whole.shape[1] - n) // 2 :][:, :n] for n in pixels.shape[:2]]
    return lay(pixels[:, :, :3], *axes, background)
