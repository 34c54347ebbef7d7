"""Session-level helpers shared by all operators: lineage cuts, parallelism and row counts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``. Where that is unset, a local folder is made on a
    local master; on a cluster, whose executors could not read it, this is a RuntimeError."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_own_dirs: dict[str, str] = {}


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. What is still in it when Python ends is deleted then: tables that a
    returned frame reads cannot be deleted before."""
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"{shared_dir(spark)}/kinweave-{app}-{uuid.uuid4().hex[:8]}"

        def clear() -> None:
            with contextlib.suppress(Exception):  # the JVM may have ended before
                _delete(spark, _own_dirs[app])

        atexit.register(clear)
    return _own_dirs[app]


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the lineage and survives lost executors. ``options``
    are the writer's."""
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def measured(df: DataFrame, options: dict[str, str] | None = None, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
    """:func:`materialise` and aggregates over all rows, taken while they are written, without another pass."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), **(options or {}))
    return out, seen.get


def together(frames: list[DataFrame]) -> DataFrame:
    """One frame of the rows of several that :func:`materialise` wrote with one schema, read as one table."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[df._kinweave_path for df in frames])


@contextlib.contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """Within it the session has these settings."""
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*frames: DataFrame | None) -> None:
    """Deletes what :func:`materialise` wrote for the frames; those from elsewhere are left alone."""
    for df in frames:
        if path := getattr(df, "_kinweave_path", None):
            _delete(df.sparkSession, path)


def parallelism(spark: SparkSession, rows: int = 0, rows_per_task: int = 250_000) -> int:
    """Number of shuffle partitions: the session's setting, or more where ``rows`` would overfill the tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Makes this package importable in the Python workers of all executors, once for each Spark application."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="kinweave-ship-"), "kinweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, Path("kinweave", file.relative_to(package)))
    spark.sparkContext.addPyFile(str(archive))
