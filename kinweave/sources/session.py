"""Sessions by size."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Memory and cores of an executor, most executors and, where given, shuffle partitions and overhead.
PRESETS = {
    "small": {"spark.executor.memory": "1g", "spark.executor.cores": "1", "spark.dynamicAllocation.maxExecutors": "3", "spark.sql.shuffle.partitions": "12"},
    "medium": {"spark.executor.memory": "6g", "spark.executor.cores": "3", "spark.dynamicAllocation.maxExecutors": "3", "spark.sql.shuffle.partitions": "18"},
    "large": {"spark.executor.memory": "10g", "spark.executor.memoryOverhead": "1g", "spark.executor.cores": "5", "spark.dynamicAllocation.maxExecutors": "5", "spark.sql.shuffle.partitions": "200"},
    "extra_large": {"spark.executor.memory": "20g", "spark.executor.memoryOverhead": "2g", "spark.executor.cores": "5", "spark.dynamicAllocation.maxExecutors": "12", "spark.sql.shuffle.partitions": "240"},
}
COMMON = {"spark.dynamicAllocation.enabled": "true", "spark.dynamicAllocation.shuffleTracking.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def settings(size: str = "large", **custom: str) -> dict[str, str]:
    """The settings of a preset (``custom`` has none of its own), overlaid with further ones."""
    if size not in (*PRESETS, "custom"):
        raise ValueError(f"size is custom or one of {', '.join(PRESETS)}")
    return COMMON | PRESETS.get(size, {}) | custom


def get_or_create(name: str, size: str = "large", master: str | None = None, hive: bool = False, **custom: str) -> SparkSession:
    """The session there is, or a new one of that size."""
    builder = SparkSession.builder.appName(name).config(map=settings(size, **custom))
    if master:
        builder = builder.master(master)
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()
