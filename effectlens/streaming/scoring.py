"""Scoring of a stream by a trained ensemble.

The engine's operators are batch operators; a stream of new rows passes through the same plan in
micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from effectlens.operators import boosting as B


def score_stream(rows: DataFrame, models: DataFrame, key: str, categorical: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Writes (key, pred), the mean over the models, of every micro-batch under sink; each batch once."""

    def one(batch: DataFrame, number: int) -> None:
        each = B.predict_folds(batch, models, "fold", key, categorical, every=True)
        mean = each.groupBy(key).agg(F.avg(F.get("pred", 0)).alias("pred"))
        mean.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
