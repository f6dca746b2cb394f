"""Scores, thresholds and verdict rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seamline import schema as S

# --- fixed values: decision parameters --------------------------------------------------------
BOX_FLOOR = 0.40
DEFECT_PERCENT = 70.0
CLEAN_CONFIDENCE = 90.0
IMAGE_THRESHOLD = 0.50
REGION_PERCENTILE = 99.5
REGION_MAX_SHARE = 0.84
REGION_FLOOR = 0.20
EDGE_SATURATION = 18.0
MAX_WEIGHT, MEAN_WEIGHT, EDGE_WEIGHT = 0.55, 0.35, 0.10
IDENTITY_PERCENTILE, IDENTITY_MARGIN = 0.05, 0.04
IDENTITY_MIN, IDENTITY_MAX = 0.72, 0.90
# --- end of fixed values ----------------------------------------------------------------------


def status_of(conf: Column, defect_percent: float = DEFECT_PERCENT) -> Column:
    """Decided on the unrounded confidence."""
    return F.when(conf * 100 >= defect_percent, S.DEFECT).otherwise(S.REVIEW)


def percent(share: Column) -> Column:
    return F.round(share * 100, 2)


def ranking_score(max_score: Column, mean_score: Column, edge_distance: Column) -> Column:
    interior = F.least(edge_distance / EDGE_SATURATION, F.lit(1.0))
    return max_score * MAX_WEIGHT + mean_score * MEAN_WEIGHT + interior * EDGE_WEIGHT


def dynamic_threshold(percentile: Column, maximum: Column, floor: float = REGION_FLOOR) -> Column:
    """Null inputs (an empty mask) leave the floor."""
    return F.greatest(F.lit(floor), percentile, maximum * REGION_MAX_SHARE)


def heuristic_confidence(area: Column, img_w: Column, img_h: Column) -> Column:
    return F.round(F.least(F.lit(95.0), 70.0 + area / (img_w * img_h) * 900.0), 2)


def heuristic_min_area(img_w: Column, img_h: Column) -> Column:
    return F.greatest(F.lit(250.0), img_w * img_h * 0.001)


def identity_threshold(percentile, margin=IDENTITY_MARGIN, low=IDENTITY_MIN, high=IDENTITY_MAX) -> Column:
    return F.least(F.greatest(percentile - margin, F.lit(low)), F.lit(high))


def first_score(score: Column) -> Column:
    """Score stored as an array: the first element, 0 where there is none."""
    return F.coalesce(F.get(score, F.lit(0)).cast("double"), F.lit(0.0))


def has_anomaly(score: Column, threshold: float = IMAGE_THRESHOLD) -> Column:
    return score >= threshold


def normalised_score(score: Column, low: Column, high: Column, threshold: Column) -> Column:
    """Scale to [0, 1] with ``threshold`` at one half, from bounds fitted on a validation set.

    Equal bounds tell only which side of the threshold a score is on: 0, one half or 1.
    """
    side = F.signum(score - threshold) / 2
    scaled = F.when(high == low, side).otherwise(F.try_divide(score - threshold, high - low)) + 0.5
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
