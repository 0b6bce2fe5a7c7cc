"""Score a stream of query cases against a fitted case base.

Prediction is stateless per query, so each micro-batch is scored with the
batch ``predict`` path inside ``foreachBatch``; no watermark or state store is
needed.  Every epoch is written to its own folder with ``overwrite``, so a
batch replayed after a failure replaces its own output (idempotent sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(queries: DataFrame, model, out_path: str, checkpoint: str, *,
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start a query that appends ``(id, prediction, epoch)`` for every micro-batch.

    ``queries`` is a streaming DataFrame with ``id`` and ``x``; ``model`` is a
    fitted :class:`casediff.plans.estimators.DifferenceModel`.
    """

    if getattr(model, "_prepared", None) is None:
        try:
            model.broadcast_case_base()         # once for all micro-batches
        except ValueError:
            pass                                # too large to broadcast: joins per batch

    def score(batch: DataFrame, epoch: int) -> None:
        preds = model.predictions(batch).withColumn("epoch", F.lit(int(epoch)))
        preds.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={int(epoch)}")

    w = queries.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()
