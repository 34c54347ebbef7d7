"""Column profile of loads of a table: from file footers where they suffice, from dictionaries next, from a scan last.

A chunk is a column of a row group. Its footer has the exact null count and the extrema, whether the row group belongs to
one load, and how large the dictionary is. All nulls, or nulls and one value, need nothing but the footer. A chunk that is
wholly dictionary-encoded, by a dictionary that is small beside it, is decoded: the dictionary gives the distinct
candidates, and its indices are counted. Columns of files in which some chunk is neither are scanned by Spark, pruned to
them. Each chunk is read once, here or there; patterns are tried on distinct values, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise, ship

FEW_VALUES = 12
MAX_PATTERNS = 10_000
MAX_TASKS = 100_000
#: Extrema of this many characters or more may be cut off in a footer.
EXACT_EXTREMA = 32
BLANK = r"(?U)\A\s*\z"
#: A dictionary of at most this many bytes, or a chunk by this many, is small.
SMALL_DICTIONARY, SMALL_PART = 4096, 4
_COUNTS = "load_no long, field_name string, value string, n long"


def _counted(column) -> tuple[pa.Array, pa.Array]:
    """The values of a chunk and how often each occurs."""
    import pyarrow.compute as pc

    values, counts = [], []
    for part in column.chunks:
        if pa.types.is_dictionary(part.type):
            at = pc.value_counts(part.indices)  # a dictionary may hold more than the chunk does
            values.append(part.dictionary.take(at.field("values")).cast(pa.string()))
        else:
            at = pc.value_counts(part)
            values.append(at.field("values").cast(pa.string()))
        counts.append(at.field("counts"))
    return pa.concat_arrays(values), pa.concat_arrays(counts)


def _from_footer(chunk, rows: int) -> list[tuple[str | None, int]] | None:
    """The values of a chunk and how often each occurs, if its footer tells."""
    s = chunk.statistics
    if s is None or not s.has_null_count:
        return None
    if s.null_count == rows:
        return [(None, rows)]
    if s.has_min_max and s.min == s.max and isinstance(s.min, str) and len(s.min) < EXACT_EXTREMA:
        return [(v, n) for v, n in ((None, s.null_count), (s.min, rows - s.null_count)) if n]
    return None


def _small_dictionary(chunk) -> bool:
    if not chunk.has_dictionary_page or chunk.dictionary_page_offset is None:
        return False
    size = chunk.data_page_offset - chunk.dictionary_page_offset
    return 0 < size <= SMALL_DICTIONARY or 0 < size * SMALL_PART <= chunk.total_compressed_size


def file_counts(fields: list[str], load_col: str):
    """For batches of file paths: value counts of those columns whose chunks footers and small dictionaries tell wholly, and
    for each other column of a file a row without a load: ``null, field, path, null``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        def out(load: list, field: list, value, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(load, pa.int64()), pa.array(field, pa.string()), value if isinstance(value, pa.Array) else pa.array(value, pa.string()), n.cast(pa.int64()) if isinstance(n, pa.Array) else pa.array(n, pa.int64())], ["load_no", "field_name", "value", "n"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    fs, at = pafs.FileSystem.from_uri(path)
                    file = pq.ParquetFile(fs.open_input_file(at), read_dictionary=fields)
                    meta = file.metadata
                    position = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                    loads = [s.min if (s := g.column(position[load_col]).statistics) is not None and s.has_min_max and s.min == s.max and s.null_count == 0 else None for g in groups]
                    chunks = {f: [g.column(position[f]) for g in groups] for f in fields}
                except (OSError, pa.ArrowException, KeyError, ValueError):  # an unknown scheme or a foreign layout
                    chunks = dict.fromkeys(fields)
                for f, own in chunks.items():
                    told = None if own is None or None in loads else [_from_footer(c, g.num_rows) for c, g in zip(own, groups)]
                    if told is None or not all(t is not None or _small_dictionary(c) for t, c in zip(told, own)):
                        yield out([None], [f], [path], [None])
                        continue
                    for g, (load, known) in enumerate(zip(loads, told)):
                        value, n = ([v for v, _ in known], [k for _, k in known]) if known is not None else _counted(file.read_row_group(g, columns=[f]).column(0))
                        yield out([load] * len(n), [f] * len(n), value, n)

    return run


def _years(value: Column) -> Column:
    return F.try_to_number(F.substring(value, 1, 4), F.lit("9999")).cast("int")


def _long(rows: DataFrame, load_col: str, fields: list[str]) -> DataFrame:
    """How often each value of each field occurs in each load."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.where(F.col(load_col).isNotNull()).select(F.col(load_col).cast("long").alias("load_no"), pairs.alias("x")).groupBy("load_no", "x.field_name", "x.value").agg(F.count("*").alias("n"))


def load_profile(df: DataFrame, load_col: str, patterns: DataFrame, year_fields: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The profile, a row for each load and field, and the value counts of fields with few values.

    Profile: ``load_no, field_name, n_rows, n_null, n_empty, n_misfit, n_distinct, max_l, min_value, max_value,
    first_year, last_year, percent_null, percent_empty, percent_misfit`` (of values neither null nor blank). ``patterns``
    (``field_name, expected_pattern``) names the fields; a whole value must fit. A field with only nulls has null extrema
    and a null ``percent_misfit``. Value counts: ``load_no, field_name, value, n``, for loads of a field with at most 12
    distinct values. Rows of a null load are left out; the fields are read as strings; an empty table has no profile.
    """
    spark = df.sparkSession
    ship(spark)
    given = patterns.select("field_name", "expected_pattern").limit(MAX_PATTERNS + 1).collect()
    if len(given) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} fields")
    pattern = {r.field_name: r.expected_pattern for r in given if r.field_name in df.columns}
    fields = list(pattern)
    strings = all(isinstance(df.schema[f].dataType, T.StringType) for f in fields)
    whole = isinstance(df.schema[load_col].dataType, T.IntegralType)
    plain = df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"  # else rows differ from files
    files = df.inputFiles() if strings and whole and plain else []
    nothing = F.lit(0).cast("long")
    parts, scans = [], {tuple(fields): None} if fields else {}
    if files and fields:
        paths = spark.createDataFrame([(p,) for p in files], "path string").repartition(min(len(files), MAX_TASKS))
        read = materialise(paths.mapInArrow(file_counts(fields, load_col), _COUNTS))
        scans = {}
        for r in read.where("load_no is null").groupBy("value").agg(F.array_sort(F.collect_set("field_name")).alias("fields")).toLocalIterator():  # a row for each file
            scans.setdefault(tuple(r.fields), []).append(r.value)
        parts.append(read.where("load_no is not null"))
    for columns, paths in scans.items():
        rows = spark.read.schema(df.schema).parquet(*paths) if paths and len(paths) < len(files) else df
        parts.append(_long(rows, load_col, list(columns)))
    none = df.select(nothing.alias("load_no"), F.lit("").alias("field_name"), F.lit("").alias("value"), nothing.alias("n")).where("false")
    values = reduce(DataFrame.unionByName, parts, none)
    values = materialise(values.groupBy("load_no", "field_name", "value").agg(F.sum("n").alias("n")) if len(parts) > 1 else values)
    v, n = F.col("value"), F.col("n")
    blank = v.rlike(BLANK)
    fits = reduce(lambda acc, f: acc.when(F.col("field_name") == f, v.rlike(rf"\A(?:{pattern[f]})\z") if pattern[f] else F.lit(True)), fields, F.when(F.lit(False), F.lit(True)))
    seen = values.select("*", blank.alias("blank"), fits.alias("fits"), F.when(F.col("field_name").isin(list(year_fields)) & fits, _years(v)).alias("year"))
    found = seen.groupBy("load_no", "field_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("n_empty"),
        F.coalesce(F.sum(F.when(~F.col("blank") & ~F.col("fits"), n)), F.lit(0)).alias("n_misfit"),
        F.count("value").alias("n_distinct"),
        F.max(F.length("value")).alias("max_l"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    profile = found.select("load_no", "field_name", "n_rows", "n_null", "n_empty", "n_misfit", "n_distinct", "max_l", "min_value", "max_value", "first_year", "last_year")
    filled = F.col("n_rows") - F.col("n_null") - F.col("n_empty")
    profile = profile.withColumns({"percent_null": 100.0 * F.col("n_null") / F.col("n_rows"), "percent_empty": 100.0 * F.col("n_empty") / F.col("n_rows"), "percent_misfit": F.try_divide(100.0 * F.col("n_misfit"), filled)})
    profile = materialise(profile)
    few = values.where("value is not null").join(profile.where(F.col("n_distinct") <= FEW_VALUES).select("load_no", "field_name"), ["load_no", "field_name"], "left_semi")
    return profile, few.select("load_no", "field_name", "value", "n")


def load_changes(profile: DataFrame, value_counts: DataFrame) -> DataFrame:
    """``load_no, field_name, finding``: what differs between a load and the one numbered one less.

    ``percent_null``, ``percent_empty`` and ``pattern`` by more than 8 points; ``distinct``: the smaller number of values
    under 0.7 of the larger; ``max_l`` by more than 15; ``years``: the first or last by more than 10; ``shares``: the
    shares' absolute differences, of fields with at most 12 values in both loads, sum to more than 0.3. What is null on
    either side is no finding. The profile has a row for each load and field, so all of this is small.
    """
    on = ["load_no", "field_name"]
    before = profile.select((F.col("load_no") + 1).alias("load_no"), "field_name", *[F.col(c).alias(f"b_{c}") for c in profile.columns if c not in on])
    shares = value_counts.join(profile.select(*on, (F.col("n_rows") - F.col("n_null")).alias("all")), on).select(*on, "value", (F.col("n") / F.col("all")).alias("share"))
    old = shares.select((F.col("load_no") + 1).alias("load_no"), "field_name", "value", F.col("share").alias("b_share"))
    moved = shares.join(old, [*on, "value"], "full").groupBy(*on).agg(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("b_share", F.lit(0.0)))).alias("moved"))
    both = profile.join(before, on).join(moved, on, "left")
    by = lambda c: F.abs(F.col(c) - F.col(f"b_{c}"))
    rules = {
        "percent_null": by("percent_null") > 8,
        "percent_empty": by("percent_empty") > 8,
        "pattern": by("percent_misfit") > 8,
        "distinct": F.least("n_distinct", "b_n_distinct") < 0.7 * F.greatest("n_distinct", "b_n_distinct"),
        "max_l": F.coalesce(by("max_l") > 15, F.lit(False)),
        "shares": (F.greatest("n_distinct", "b_n_distinct") <= FEW_VALUES) & (F.least("n_distinct", "b_n_distinct") > 0) & (F.col("moved") > 0.3),
        "years": (by("first_year") > 10) | (by("last_year") > 10),
    }
    return both.select(*on, F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("finding"))


def profile_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The profile of the received records against their fields' patterns."""
    from ..runtime import table

    return load_profile(table(spark, sf_dir, "df"), "load_no", table(spark, sf_dir, "field_patterns"), ("dob",))
