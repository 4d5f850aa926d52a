"""An extension: incremental invalidation as a stream of change files.

Change sets arrive as JSON files (path, status); each micro-batch closes them over the dependency
graph and appends the files to be rebuilt.  The graph is read anew for each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.graph import affected_with_reason


def invalidations(spark: SparkSession, changes: str, edges: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    stream = spark.readStream.schema("path string, status string").json(changes)

    def close(batch: DataFrame, batch_id: int) -> None:
        # written under the batch's number, so that a batch that is run again replaces itself
        affected_with_reason(batch, edges()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(close).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
