"""Pictures laid on a square canvas in bands: as whole weight matrices lay them, without multiplying by their zeros."""

import numpy as np
import pytest

from seamline.functions import raster


def whole(pixels, size, background=205):
    """Every axis through one weight matrix of the whole picture."""
    parts = raster.extents(pixels, 0.04)
    scale = size / max(stop - start for start, stop in parts)
    targets = [max(1, round((stop - start) * scale)) for start, stop in parts]
    kind = "area" if scale < 1 else "cubic"
    axes = [raster.axis_weights(n, part, target, size, kind) for n, part, target in zip(pixels.shape, parts, targets)]
    return np.clip(np.rint(raster.lay(pixels, *axes, background)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("channels", [3, 4])
@pytest.mark.parametrize("alpha", [[0, 255], range(256)])
def test_bands_give_the_pixels_of_whole_matrices(channels, alpha):
    rng = np.random.default_rng(3)
    for _ in range(40):
        pixels = rng.integers(0, 5, (*rng.integers(3, 70, 2), 4)).astype(np.uint8) * 60
        pixels[:, :, 3] = rng.choice(alpha, pixels.shape[:2])
        size = int(rng.integers(4, 90))
        assert (raster.boxed(pixels[:, :, :channels], size) == whole(pixels[:, :, :channels], size)).all()


def test_whole_matrices_are_left_to_ties(monkeypatch):
    plain = np.full((90, 160, 3), 150, np.uint8)
    tied = np.repeat(np.array([[[0], [1]]], np.uint8), 3, axis=2)
    expected = whole(tied, 1)
    calls, lay = [], raster.lay
    monkeypatch.setattr(raster, "lay", lambda *args: calls.append(args) or lay(*args))
    assert (raster.boxed(plain, 128)[28:100] == 150).all() and not calls
    assert (raster.boxed(tied, 1) == expected).all() and len(calls) == 1
