"""Streams. The verbs of operators.shape, operators.clean and operators.quality that work row by row take a streaming frame
as they take any other; ``standardised_stream`` chains them between a source and a sink."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

Verb = Callable[[DataFrame], DataFrame]


def standardised_stream(spark: SparkSession, schema: T.StructType | str, source: str, sink: str, checkpoint: str, verbs: list[Verb], file_format: str = "parquet") -> StreamingQuery:
    """Files as they arrive in ``source``, through the row-wise ``verbs``, appended to ``sink``; exactly once by ``checkpoint``."""
    rows = spark.readStream.schema(schema).format(file_format).load(source)
    made = reduce(lambda d, v: d.transform(v), verbs, rows)
    return made.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True).start()
