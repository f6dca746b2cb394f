"""Live figures over a stream of inspections; each also runs on a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline import schema as S


def _watermarked(rows: DataFrame, ts: str, lateness: str) -> DataFrame:
    return rows.withWatermark(ts, lateness) if rows.isStreaming else rows


def live_kpis(
    inspections: DataFrame, ts: str = "created_at", width: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Counts by verdict in tumbling windows of event time."""
    rows = _watermarked(inspections, ts, lateness)
    counted = rows.groupBy(F.window(ts, width)).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == S.DEFECT).alias("defects"),
        F.count_if(F.col("status") == S.APPROVED).alias("approved"),
        F.count_if(F.col("status") == S.REVIEW).alias("review"),
    )
    return counted.select(
        F.col("window.start").alias("window_start"), "total", "defects", "approved", "review"
    )


def station_sessions(
    captures: DataFrame, gap: str, ts: str = "ts", lateness: str = "10 minutes"
) -> DataFrame:
    """Periods of activity per station, ended by a pause of ``gap``."""
    rows = _watermarked(captures, ts, lateness)
    grouped = rows.groupBy("station_id", F.session_window(ts, gap).alias("period"))
    return grouped.agg(F.count("*").alias("captures")).select(
        "station_id",
        F.col("period.start").alias("started"),
        F.col("period.end").alias("ended"),
        "captures",
    )


def without_repeats(frames: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Each frame once, however often its delivery was repeated within the watermark."""
    if frames.isStreaming:
        return frames.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
    return frames.dropDuplicates(keys)
