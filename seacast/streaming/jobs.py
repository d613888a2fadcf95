"""Streaming scoring and incremental consolidation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from seacast.models.train import score
from seacast.operators.dedupe import keep_first
from seacast.schemas import SCORE_REQUEST


def read_requests(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Score requests as they land (one JSON object per line)."""
    reader = spark.readStream.schema(SCORE_REQUEST)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(landing)


def score_stream(model: PipelineModel, requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Scores every arrived record into a Parquet folder, then stops (availableNow). Stateless."""
    return (
        score(model, requests)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _merge_batch(out: str, date: str, order: list[str]):
    """foreachBatch body: adds the first row of each date that the table lacks. Dates are parsed first, so two texts of
    one date are one date; a row without a readable date is left out.

    Only the months of the batch are read back (their list is bounded by the calendar). A
    replayed batch finds its dates present and adds nothing, so the merge is idempotent.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn(date, F.col(date).cast("string").try_cast("date")).where(F.col(date).isNotNull())
        rows = keep_first(dated, [date], order).drop(*order).withColumns({"year": F.year(date), "month": F.month(date)})
        try:
            table = spark.read.parquet(out)
        except AnalysisException as none:  # nothing is written yet
            if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            rows.write.mode("append").partitionBy("year", "month").parquet(out)
            return
        rows = rows.persist()
        month_no = F.col("year") * 12 + F.col("month")
        months = [r[0] for r in rows.select(month_no).distinct().collect()]
        known = table.where(month_no.isin(months)).select("year", "month", date)
        rows.join(known, ["year", "month", date], "left_anti").write.mode("append").partitionBy("year", "month").parquet(out)
        rows.unpersist()

    return merge


def consolidate_stream(landed: DataFrame, out: str, checkpoint: str, order: list[str], date: str = "date") -> StreamingQuery:
    """Nightly consolidation: landed rows into the daily table, first row per date."""
    return (
        landed.writeStream.foreachBatch(_merge_batch(out, date, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class FirstInTask:
    """The rows of a task's batches to the first of each key in order: what reaches a key's state is one row for each batch of rows."""

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values([self.key, *self.order]).drop_duplicates(self.key)


def keep_first_stream(landed: DataFrame, order: list[str], date: str = "date", ttl: str = "400 days") -> DataFrame:
    """The stream of first rows of each date: the first to arrive, within one micro-batch the first in ``order``.

    The state holds for each date that its row is out. It is dropped once the stream's greatest date is ``ttl`` beyond
    the date, and rows that arrive later than that are left out, so the state is bounded by the calendar and a date
    never has two rows. Dates are parsed first; rows without a readable date are left out. Restarted from its
    checkpoint the stream goes on with the same state.
    """
    day = F.col(date).cast("string").try_cast("date")
    dated = landed.withColumn(date, day).where(F.col(date).isNotNull())
    few = dated.mapInPandas(FirstInTask(date, order), dated.schema).withColumn("_at", F.col(date).cast("timestamp")).withWatermark("_at", ttl)
    kept, schema = [c for c in dated.columns if c not in order], few.schema

    def first(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order)
        end = int(rows["_at"].iloc[0].timestamp() * 1000)
        if not state.exists and end >= state.getCurrentWatermarkMs():
            state.update((True,))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
            yield rows[kept].iloc[:1]

    out = StructType([f for f in schema.fields if f.name in kept])
    return few.groupBy(date).applyInPandasWithState(first, out, "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)


def consolidate_by_state(landed: DataFrame, out: str, checkpoint: str, order: list[str], date: str = "date", ttl: str = "400 days") -> StreamingQuery:
    """Nightly consolidation with the dates that are out in the stream's state: nothing of the written table is read back."""
    return (
        keep_first_stream(landed, order, date, ttl)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
