"""Ingestion by stream: totals that are kept up to date micro-batch by micro-batch give the rows of the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registered import query
from ..sources.shared import shared_path


@query("stream_totals", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_totals(spark, sf_dir):
    """Totals kept by a stream over the events. A batch's changed totals (update mode) are written under its number, over what an earlier
    attempt has left there, so a batch that is done twice counts once; a key's last ones count."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    totals = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    path = shared_path(spark, "totals")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    totals.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(path)
    last = written.groupBy("user_id", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("t"))
    return last.select("user_id", "event_type", "t.n", F.round("t.total", 4).alias("total"))
