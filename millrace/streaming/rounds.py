"""Multi-round clustering over a stream of point files.

Files that arrive in a folder are read in order, one a micro-batch, and each
batch is one round of the clusterer. The state lives in the clusterer object,
so one query feeds one clusterer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.clustering import SummarisingClusterer


def point_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(id, vec) from headerless numeric CSV files, one file a batch."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).option("latestFirst", "false").load(folder)
    fields = F.split("value", ",")
    vec = F.transform(F.slice(fields, F.lit(2), F.size(fields) - 1), lambda x: x.cast("double"))
    return lines.where("trim(value) <> ''").select(F.trim(fields[0]).cast("long").alias("id"), vec.alias("vec"))


def cluster_stream(points: DataFrame, clusterer: SummarisingClusterer, checkpoint: str) -> StreamingQuery:
    """Feeds every micro-batch to the clusterer until the input is used up."""

    def take(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            clusterer.add_round(batch)

    return points.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
