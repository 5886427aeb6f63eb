"""Residuals of scenarios as their files arrive: the batch operators inside ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridweave.operators.residual import power_residual, residual_inf
from gridweave.sources.scenarios import append_batches


def watch_residuals(buses: DataFrame, ybus: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each arriving scenario's largest residuals to ``path`` until the present files are done.

    ``buses`` is a stream of whole scenarios (all buses of one in a file), ``ybus``
    a table. A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        residual_inf(power_residual(batch, ybus)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return buses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str, rows_per_file: int = 1_000_000) -> StreamingQuery:
    """Appends a stream under ``path`` batch by batch until the present files are done; a batch that is run again is not written twice."""

    def write(batch: DataFrame, number: int) -> None:
        append_batches(batch, path, str(number), rows_per_file)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
