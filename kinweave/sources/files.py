"""Files: reading, writing, listing and searching, on whatever file system a path names."""

from __future__ import annotations

import re
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "hive")


def _format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    return name


def read_format(spark: SparkSession, read: str, path: str, file_name: str | None = None, sep: str = ",", header: bool = True, infer_schema: bool = True, schema: str | T.StructType | None = None) -> DataFrame:
    """A csv or parquet path (``path/file_name`` or ``path``), or the table ``path.file_name``. A ``schema`` saves csv its inference scan."""
    if _format(read) == "hive":
        return spark.table(f"{path}.{file_name}" if file_name else path)
    at = f"{path}/{file_name}" if file_name else path
    reader = spark.read if schema is None else spark.read.schema(schema)
    if read == "parquet":
        return reader.parquet(at)
    return reader.options(sep=sep, header=header, inferSchema=infer_schema and schema is None).csv(at)


def write_format(df: DataFrame, write: str, path: str, file_name: str | None = None, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    """The counterpart of :func:`read_format`; ``mode`` holds for tables too."""
    writer = df.write.mode(mode)
    if _format(write) == "hive":
        writer.saveAsTable(f"{path}.{file_name}" if file_name else path)
    elif write == "parquet":
        writer.parquet(f"{path}/{file_name}" if file_name else path)
    else:
        writer.options(sep=sep, header=header).csv(f"{path}/{file_name}" if file_name else path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _statuses(spark: SparkSession, path: str, walk: bool) -> list[tuple[str, bool, int]]:
    """(path, whether a directory, modified) of what lies in a directory, files of directories below it too with ``walk``."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return []
    if not walk:
        return [(s.getPath().toString(), s.isDirectory(), s.getModificationTime()) for s in fs.listStatus(at)]
    out, it = [], fs.listFiles(at, True)
    while it.hasNext():
        s = it.next()
        out.append((s.getPath().toString(), False, s.getModificationTime()))
    return out


def list_files(spark: SparkSession, path: str, walk: bool = False, regex: str | None = None, full_path: bool = True) -> list[str]:
    """What lies in ``path``, sorted, as paths or base names, filtered by ``re.search``; nothing if there is no such path."""
    names = [n if full_path else n.rstrip("/").rsplit("/", 1)[-1] for n, _, _ in _statuses(spark, path, walk)]
    return sorted(n for n in names if regex is None or re.search(regex, n))


def list_checkpoints(spark: SparkSession, path: str) -> list[str]:
    """The files in the first entry of a checkpoint folder."""
    entries = list_files(spark, path)
    return list_files(spark, entries[0]) if entries else []


def most_recent(spark: SparkSession, path: str, file_type: str, regex: str | None = None) -> tuple[str, str]:
    """``(path, file_type)`` of the folder with the newest file of that suffix, or of the table made last in database ``path``.

    ``regex`` is matched from the start of the full path or of ``database.table``. FileNotFoundError if nothing fits.
    """
    fits = lambda n: regex is None or re.match(regex, n) is not None
    if _format(file_type) == "hive":
        made = {f"{path}.{t.name}": _created(spark, f"{path}.{t.name}") for t in spark.catalog.listTables(path) if not t.isTemporary}
        found = [(when, n) for n, when in made.items() if fits(n)]
    else:
        found = [(when, n.rsplit("/", 1)[0]) for n, folder, when in _statuses(spark, path, True) if not folder and n.endswith(file_type) and fits(n)]
    if not found:
        raise FileNotFoundError(f"no {file_type} in {path}")
    return max(found)[1], file_type


def _created(spark: SparkSession, table: str) -> float:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Created Time'").collect()
    return time.mktime(time.strptime(re.sub(r" [A-Z]{2,5} ", " ", rows[0].data_type), "%a %b %d %H:%M:%S %Y")) if rows else 0.0


def search_files(path: str, text: str) -> dict[str, list[int]]:
    """For every file of a local folder (not below it) with ``text``: the numbers of those lines, from 1. Files that are no text are left out."""
    out = {}
    for file in sorted(Path(path).iterdir()):
        if file.is_file():
            try:
                hits = [i for i, line in enumerate(file.read_text().splitlines(), 1) if text in line]
            except UnicodeDecodeError:
                continue
            if hits:
                out[file.name] = hits
    return out


def copy_local_file(spark: SparkSession, local: str, remote: str) -> None:
    """Copies a driver's file to another file system, over what is there."""
    fs, at = _file_system(spark, remote)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{Path(local).resolve()}"), at)


def pandas_to_spark(spark: SparkSession, frame) -> DataFrame:
    """A pandas frame with datetime64 as timestamp, int64 and int32 as bigint and int, floats likewise, all else as string."""
    kinds = {"int64": T.LongType(), "int32": T.IntegerType(), "float64": T.DoubleType(), "float32": T.FloatType()}
    fields = [T.StructField(str(c), T.TimestampType() if str(t).startswith("datetime64") else kinds.get(str(t), T.StringType())) for c, t in frame.dtypes.items()]
    text = {f.name for f in fields if isinstance(f.dataType, T.StringType)}
    ready = frame.copy()
    ready.columns = [f.name for f in fields]
    for c in text:
        ready[c] = [None if v is None or v != v else str(v) for v in ready[c]]
    return spark.createDataFrame(ready, T.StructType(fields))


def chunk_list(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
