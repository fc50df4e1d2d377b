"""Following logs: a stateless stream of new lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader

from ..operators.logs import streams


def tail(source: DataFrame, matchers: tuple[tuple[str, str, str], ...] = (), pipeline: Callable[[DataFrame], DataFrame] = lambda logs: logs) -> DataFrame:
    """New lines of the matching streams through a pipeline of stateless log operators, in append mode."""
    return pipeline(streams(source, *matchers))


def follow(spark: SparkSession, path: str, schema, per_poll: int = 100) -> DataFrame:
    """A streaming frame of log records from the files that appear in a folder, so many files a poll."""
    reader: DataStreamReader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_poll)
    return reader.parquet(path)
