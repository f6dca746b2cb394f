"""Continuous registration: every micro-batch of captures becomes inspection rows once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from seamline.operators.register import AUTOMATIC, register, with_defaults


def registration_writer(
    captures: DataFrame,
    verdicts_of: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    mode: str = AUTOMATIC,
    identity_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataStreamWriter:
    """Writer that registers a stream of captures (image_id, captured_at) into ``path``.

    Each micro-batch owns one folder that it overwrites, and codes derive from the capture key, so a
    repeated batch leaves the same rows behind.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        identity = identity_of(batch) if identity_of else None
        rows = with_defaults(register(batch, verdicts_of(batch), identity, mode))
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
