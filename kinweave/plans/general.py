"""Queries of the core's own operators on large tables: column profiles (2) and skewed keys (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.column_profile import load_changes, profile_table
from ..operators.eager_aggregation import eager_join_aggregate, heavy_keys
from ..runtime import table
from . import query

_LONG = " UNION ALL ".join(f"SELECT CAST(load_no AS BIGINT) AS load_no, '{f}' AS field_name, {f} AS value FROM df" for f in ("forename", "middlename", "surname", "dob", "sex", "postcode"))
_PROFILE = f"""
    long AS ({_LONG}),
    seen AS (
        SELECT load_no, field_name, value, regexp_full_match(value, '\\s*') AS blank, regexp_full_match(value, expected_pattern) AS fits,
            CASE WHEN field_name = 'dob' AND regexp_full_match(value, expected_pattern) THEN TRY_CAST(value[1:4] AS INTEGER) END AS year
        FROM long JOIN field_patterns USING (field_name)
    ),
    profile AS (
        SELECT load_no, field_name, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (blank) AS n_empty,
            count(*) FILTER (NOT blank AND NOT fits) AS n_misfit, count(DISTINCT value) AS n_distinct, CAST(max(length(value)) AS INTEGER) AS max_l,
            min(value) AS min_value, max(value) AS max_value, min(year) AS first_year, max(year) AS last_year,
            100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*) AS percent_null, 100.0::DOUBLE * count(*) FILTER (blank) / count(*) AS percent_empty,
            100.0::DOUBLE * count(*) FILTER (NOT blank AND NOT fits) / nullif(count(*) FILTER (NOT blank), 0) AS percent_misfit
        FROM seen GROUP BY load_no, field_name
    )"""


@query(f"""
    WITH {_PROFILE},
    shares AS (
        SELECT load_no, field_name, value, count(*)::DOUBLE / (SELECT n_rows - n_null FROM profile p WHERE p.load_no = s.load_no AND p.field_name = s.field_name) AS share
        FROM seen s WHERE value IS NOT NULL GROUP BY load_no, field_name, value
    ),
    moved AS (
        SELECT coalesce(a.load_no, b.load_no + 1) AS load_no, coalesce(a.field_name, b.field_name) AS field_name, sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) AS moved
        FROM shares a FULL JOIN shares b ON a.field_name = b.field_name AND a.load_no = b.load_no + 1 AND a.value = b.value GROUP BY 1, 2
    ),
    sides AS (
        SELECT a.load_no, a.field_name, moved, abs(a.percent_null - b.percent_null) > 8 AS percent_null, abs(a.percent_empty - b.percent_empty) > 8 AS percent_empty,
            abs(a.percent_misfit - b.percent_misfit) > 8 AS pattern, least(a.n_distinct, b.n_distinct) < 0.7 * greatest(a.n_distinct, b.n_distinct) AS "distinct",
            abs(a.max_l - b.max_l) > 15 AS max_l, greatest(a.n_distinct, b.n_distinct) <= 12 AND moved > 0.3 AS shares,
            abs(a.first_year - b.first_year) > 10 OR abs(a.last_year - b.last_year) > 10 AS years
        FROM profile a JOIN profile b ON a.field_name = b.field_name AND a.load_no = b.load_no + 1
        LEFT JOIN moved m ON m.load_no = a.load_no AND m.field_name = a.field_name
    )
    SELECT load_no, field_name, finding FROM (UNPIVOT (SELECT * EXCLUDE (moved) FROM sides) ON percent_null, percent_empty, pattern, "distinct", max_l, shares, years INTO NAME finding VALUE found) WHERE found""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_changes(*profile_table(spark, sf_dir)).select(F.col("load_no").cast("int").alias("load_no"), "field_name", "finding")


@query(f"WITH {_PROFILE} SELECT load_no, field_name, n_rows, n_null, n_empty, n_misfit, n_distinct, max_l, min_value, max_value, first_year, last_year FROM profile")
def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(spark, sf_dir)[0].drop("percent_null", "percent_empty", "percent_misfit")


@query("""
    SELECT 'surname' AS key_field, surname AS key_value FROM df WHERE surname IS NOT NULL GROUP BY surname HAVING count(*) >= (SELECT count(*) FROM df) / 40.0
    UNION ALL
    SELECT 'matchkey', CAST(matchkey AS VARCHAR) FROM matchkey_join GROUP BY matchkey HAVING count(*) >= (SELECT count(*) FROM matchkey_join) / 40.0""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, left = table(spark, sf_dir, "df"), table(spark, sf_dir, "df_l")
    pairs, about = table(spark, sf_dir, "matchkey_join"), table(spark, sf_dir, "matchkey_descriptions")
    surnames = heavy_keys(df, F.col("surname"), left, F.col("last_name"), 40)
    keys = heavy_keys(pairs, F.col("matchkey"), about, F.col("matchkey"), 40)
    return surnames.select(F.lit("surname").alias("key_field"), F.col("key").alias("key_value")).unionByName(keys.select(F.lit("matchkey").alias("key_field"), F.col("key").cast("string").alias("key_value")))


@query("""
    SELECT surname, count(DISTINCT id) AS n_left, count(DISTINCT l_id) AS n_right, count(*) AS n_pairs, CAST(sum(load_no) AS BIGINT) AS load_sum, CAST(sum(length(uprn)) AS BIGINT) AS uprn_chars
    FROM df JOIN df_l ON surname = last_name GROUP BY surname""")
def p3_surname_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = eager_join_aggregate(table(spark, sf_dir, "df"), table(spark, sf_dir, "df_l"), F.col("surname"), F.col("last_name"), {"load_sum": F.col("load_no").cast("long")}, {"uprn_chars": F.length("uprn").cast("long")})
    return made.select(F.col("key").alias("surname"), "n_left", "n_right", F.col("n_pairs").cast("long").alias("n_pairs"), "load_sum", "uprn_chars")


@query("SELECT load_no, count(*) AS n_pairs FROM df JOIN df_l ON surname = last_name GROUP BY load_no")
def p3_load_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = eager_join_aggregate(table(spark, sf_dir, "df"), table(spark, sf_dir, "df_l"), F.col("surname"), F.col("last_name"), left_by={"load_no": F.col("load_no")}, roll_up=["load_no"])
    return made.select("load_no", F.col("n_pairs").cast("long").alias("n_pairs"))


@query("SELECT matchkey, description, count(*) AS n_rows FROM matchkey_join JOIN matchkey_descriptions USING (matchkey) GROUP BY ALL")
def p3_matchkey_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = eager_join_aggregate(table(spark, sf_dir, "matchkey_join"), table(spark, sf_dir, "matchkey_descriptions"), F.col("matchkey"), F.col("matchkey"), right_by={"description": F.col("description")}, roll_up=["key", "description"])
    return made.select(F.col("key").alias("matchkey"), "description", F.col("n_pairs").cast("long").alias("n_rows"))
