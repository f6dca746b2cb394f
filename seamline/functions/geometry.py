"""Box and region geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seamline import schema as S

# --- fixed values -----------------------------------------------------------------------------
LEFT_SHARE, RIGHT_SHARE = 0.33, 0.66
DEFAULT_ROI = (0.10, 0.10, 0.90, 0.90)
# --- end of fixed values ----------------------------------------------------------------------


def zone(center_x: Column, width: Column) -> Column:
    return (
        F.when(center_x < width * LEFT_SHARE, S.ZONE_LEFT)
        .when(center_x > width * RIGHT_SHARE, S.ZONE_RIGHT)
        .otherwise(S.ZONE_FRONT)
    )


def normalised_box(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """Corner box in pixels to centre box in shares of the image."""
    return F.struct(
        ((x + w / 2) / img_w).alias("xc"),
        ((y + h / 2) / img_h).alias("yc"),
        (w / img_w).alias("w"),
        (h / img_h).alias("h"),
    )


def pixel_box(xc: Column, yc: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """Inverse of :func:`normalised_box`, as two corners."""
    return F.struct(
        ((xc - w / 2) * img_w).alias("x1"),
        ((yc - h / 2) * img_h).alias("y1"),
        ((xc + w / 2) * img_w).alias("x2"),
        ((yc + h / 2) * img_h).alias("y2"),
    )


def roi_bounds(img_w: Column, img_h: Column, roi=DEFAULT_ROI) -> Column:
    """Pixel bounds of the inspected region, or null when the region is empty."""

    def low(share, size):
        return F.floor(F.lit(max(0.0, min(share, 0.99))) * size).cast("int")

    def high(share, size):
        return F.floor(F.lit(max(0.01, min(share, 1.0))) * size).cast("int")

    x1, y1, x2, y2 = low(roi[0], img_w), low(roi[1], img_h), high(roi[2], img_w), high(roi[3], img_h)
    bounds = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), bounds)


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of the corner boxes whose columns carry prefixes ``a`` and ``b``."""

    def side(low, high):
        return F.greatest(
            F.lit(0.0),
            F.least(F.col(a + high), F.col(b + high)) - F.greatest(F.col(a + low), F.col(b + low)),
        )

    def area(p):
        return (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1"))

    shared = side("x1", "x2") * side("y1", "y2")
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))
