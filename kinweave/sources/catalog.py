"""Tables of the catalogue; names are quoted, never pasted into statements unchecked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts if p)


def create_hive_table(df: DataFrame, database: str, table: str) -> None:
    """A new table of the frame's rows; an error if it exists."""
    df.write.mode("errorifexists").saveAsTable(_name(database, table))


def clone_hive_table(spark: SparkSession, database: str, table: str, new_table: str, suffix: str = "") -> None:
    spark.table(_name(database, table)).write.mode("errorifexists").saveAsTable(_name(database, new_table + suffix))


def rename_hive_table(spark: SparkSession, database: str, table: str, new_name: str) -> None:
    spark.sql(f"ALTER TABLE {_name(database, table)} RENAME TO {_name(database, new_name)}")


def drop_hive_table(spark: SparkSession, database: str, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_name(database, table)}")


def list_tables(spark: SparkSession, database: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]


def _tables(spark: SparkSession, database: str, regex: str | None) -> list[str]:
    return [t for t in list_tables(spark, database) if regex is None or re.match(regex, t)]


def create_table_statements(spark: SparkSession, database: str, regex: str | None = None) -> DataFrame:
    """``table, createtab_stmt`` of every table whose name matches from its start."""
    made = [(t, spark.sql(f"SHOW CREATE TABLE {_name(database, t)}").first()[0]) for t in _tables(spark, database, regex)]
    return spark.createDataFrame(made, "table string, createtab_stmt string")


def hive_dtypes(spark: SparkSession, database: str, table: str) -> list[tuple[str, str]]:
    return spark.table(_name(database, table)).dtypes


def hive_variable_matrix(spark: SparkSession, database: str, regex: str | None = None) -> DataFrame:
    """``variable`` (sorted) and a column for each table with the variable's type there, '' where it is not."""
    tables = _tables(spark, database, regex)
    rows = [(c, t, d) for t in tables for c, d in hive_dtypes(spark, database, t)]
    long = spark.createDataFrame(rows, "variable string, table string, type string")
    return long.groupBy("variable").pivot("table", tables).agg(F.first("type")).na.fill("").orderBy("variable")


