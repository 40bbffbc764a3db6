"""Counts of strata as their files arrive: strata are independent, so results only append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import counts
from ..operators.graph import combinations, combo_columns


def follow(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, size: int = 2, files: int = 100) -> StreamingQuery:
    """Starts counting the combinations of new compound files; out is keyed by batch, so retries overwrite."""

    def count(batch: DataFrame, number: int) -> None:
        counts(combinations(batch, size), combo_columns(size)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
