"""Incremental runs: what is new since the last run goes through a transformation once and is appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from specloom.sources.files import write_new


def run_once(spark: SparkSession, source: str, schema: StructType | str, made: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "slug") -> None:
    """Reads the Parquet files that came to ``source`` since the last run, and appends rows with keys new to ``target``.

    A batch that is repeated after a failure finds its keys there already, so rows are not doubled.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write_new(made(df), target, key) and None).start()
    query.awaitTermination()
