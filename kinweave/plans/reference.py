"""Queries of the linkage and cleaning verbs, each over whole tables, with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetic, similarity, text
from ..operators import clean, clusters, disclosure, link, profile, quality, shape, windows
from ..operators.matchkey import MatchKey, any_of, eq, eq_fn, matchkey_dataframe, score, suffix_of
from ..runtime import shared_dir
from ..runtime import table as at
from ..sources import catalog, files
from . import query

# Columns and rows


@query("SELECT DISTINCT c_name, c_nationkey FROM customer")
def select_prefix(spark: SparkSession, d: str) -> DataFrame:
    return shape.select(at(spark, d, "customer"), startswith="c_na")


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_criteria(spark: SparkSession, d: str) -> DataFrame:
    return shape.select(at(spark, d, "lineitem"), startswith="l_", endswith="key", regex="_[ops]")


@query("SELECT DISTINCT n_name FROM nation")
def drop_suffix(spark: SparkSession, d: str) -> DataFrame:
    return shape.drop_columns(at(spark, d, "nation"), endswith="key")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def rename_cols(spark: SparkSession, d: str) -> DataFrame:
    return shape.rename_columns(at(spark, d, "nation"), {"n_nationkey": "id", "n_name": "name"})


@query("SELECT r_regionkey, r_name AS x_r_name FROM region")
def prefix_cols(spark: SparkSession, d: str) -> DataFrame:
    return shape.prefix_columns(at(spark, d, "region"), "x_", ["r_regionkey"])


@query("SELECT r_regionkey AS r_regionkey_x, r_name AS r_name_x FROM region")
def suffix_cols(spark: SparkSession, d: str) -> DataFrame:
    return shape.suffix_columns(at(spark, d, "region"), "_x")


@query("SELECT *, 'new' AS source FROM supplier")
def literal_col(spark: SparkSession, d: str) -> DataFrame:
    return shape.literal_column(at(spark, d, "supplier"), "source", "new")


@query("SELECT *, s_name AS s_copy FROM supplier")
def clone_col(spark: SparkSession, d: str) -> DataFrame:
    return shape.clone_column(at(spark, d, "supplier"), "s_name", "s_copy")


@query("SELECT id, TRY_CAST(postcode AS INTEGER) AS postcode, TRY_CAST(sex AS INTEGER) AS sex FROM df")
def cast_types(spark: SparkSession, d: str) -> DataFrame:
    return shape.cast_type(at(spark, d, "df").select("id", "postcode", "sex"), ["postcode", "sex"], "int")


@query("SELECT l_id, coalesce(date_of_birth, CAST(recorded_ts AS VARCHAR)) AS coalesced_col FROM df_l")
def coalesce_mixed(spark: SparkSession, d: str) -> DataFrame:
    return shape.coalesced(at(spark, d, "df_l"), ["date_of_birth", "recorded_ts"], drop=True).select("l_id", "coalesced_col")


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-15'")
def cut_off_date(spark: SparkSession, d: str) -> DataFrame:
    return shape.cut_off(at(spark, d, "orders"), "o_orderdate", "1997-01-15", ">=")


@query("SELECT * FROM df WHERE forename IS NOT NULL AND sex IS NOT NULL AND sex <> 'U' AND forename <> 'U'")
def drop_nulls_value(spark: SparkSession, d: str) -> DataFrame:
    return shape.drop_nulls(at(spark, d, "df"), ["forename", "sex"], "U")


@query("SELECT c_custkey AS id, c_name, 'none' AS s_name FROM customer UNION ALL SELECT s_suppkey, 'none', s_name FROM supplier")
def union_fill(spark: SparkSession, d: str) -> DataFrame:
    c = at(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    s = at(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return shape.union_all(c, s, fill="none")


_JOINED = "nullif(regexp_replace(regexp_replace(concat_ws(' ', {}), '( )+', ' ', 'g'), '^ | $', '', 'g'), '')"


@query(f"SELECT id, {_JOINED.format('forename, middlename, surname')} AS full_name FROM df")
def concat_cols(spark: SparkSession, d: str) -> DataFrame:
    return shape.concat(at(spark, d, "df"), "full_name", ["forename", "middlename", "surname"]).select("id", "full_name")


@query("SELECT p_partkey, reverse(substring(reverse(p_name), 2, 3)) AS tail, substring(p_name, 1, 3) AS head FROM part")
def substring_ends(spark: SparkSession, d: str) -> DataFrame:
    p = shape.substring(at(spark, d, "part"), "tail", "p_name", 2, 3, from_end=True)
    return shape.substring(p, "head", "p_name", 1, 3).select("p_partkey", "tail", "head")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last, nullif(array_to_string(string_split(p_name, ' ')[1:2], ' '), '') AS both FROM part")
def split_index(spark: SparkSession, d: str) -> DataFrame:
    p = shape.split(at(spark, d, "part"), "p_name", "words")
    for name, index in (("first", 0), ("last", -1), ("both", (0, 2))):
        p = shape.index_select(p, "words", name, index)
    return p.select("p_partkey", "first", "last", "both")


@query("SELECT DISTINCT id, unnest(string_split(surname, '-')) AS surname FROM df WHERE contains(surname, '-') UNION SELECT id, surname FROM df WHERE surname IS NULL OR NOT contains(surname, '-')")
def explode_tokens(spark: SparkSession, d: str) -> DataFrame:
    return shape.explode(at(spark, d, "df").select("id", "surname"), "surname", "-")


@query("""
    SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS p_name, true AS is_part FROM part WHERE contains(p_name, ' ')
    UNION SELECT p_partkey, p_name, false FROM part""")
def explode_retain(spark: SparkSession, d: str) -> DataFrame:
    return shape.explode(at(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ", retain=True, flag="is_part")


@query("SELECT o_orderkey, round(abs(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) - epoch(TIMESTAMP '1995-06-17')) / 86400, 2) AS days FROM orders")
def date_diff_days(spark: SparkSession, d: str) -> DataFrame:
    o = at(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.lit("1995-06-17").alias("b"))
    return shape.date_diff(o, "a", "b", "days").select("o_orderkey", "days")


@query("SELECT o_orderkey, round((epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) - epoch(TIMESTAMP '1995-06-17')) / (31 * 86400), 2) AS months FROM orders")
def date_diff_months(spark: SparkSession, d: str) -> DataFrame:
    o = at(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.lit("1995-06-17").alias("b"))
    return shape.date_diff(o, "a", "b", "months", units="months", absolute=False).select("o_orderkey", "months")


# Cleaning


@query("SELECT e.* REPLACE (CASE WHEN event_type IN ('view', 'error') THEN -1.0 ELSE value END AS value) FROM events e")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    e = at(spark, d, "events")
    gaps = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return clean.fill_nulls(e.withColumn("value", gaps), "-1", "value")


@query("SELECT id, CASE WHEN regexp_matches(sex, '^(U|9|)$') THEN NULL ELSE sex END AS sex, CASE WHEN regexp_matches(postcode, '^\\s*$') THEN NULL ELSE postcode END AS postcode FROM df")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    df = clean.standardise_null(at(spark, d, "df"), "^(U|9|)$", "sex")
    return clean.standardise_null(df, r"^\s*$", "postcode").select("id", "sex", "postcode")


@query("SELECT id, regexp_replace(trim(forename), '\\s+', ' ', 'g') AS forename, regexp_replace(trim(surname), '\\s+', '', 'g') AS surname, regexp_replace(trim(postcode), '\\s+', '_', 'g') AS postcode FROM df")
def white_space(spark: SparkSession, d: str) -> DataFrame:
    df = clean.standardise_white_space(at(spark, d, "df"), "forename")
    df = clean.standardise_white_space(df, "surname", "none")
    return clean.standardise_white_space(df, "postcode", fill="_").select("id", "forename", "surname", "postcode")


@query("SELECT id, trim(forename) AS forename, trim(surname) AS surname FROM df")
def trim(spark: SparkSession, d: str) -> DataFrame:
    return clean.trim(at(spark, d, "df")).select("id", "forename", "surname")


_STANDARD = "upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '\\s+', ' ', 'g'), '[^A-Za-z0-9 -]', '', 'g'), ' ?- ?', '-', 'g'), '^-+|-+$', '', 'g'))"
_NAMES = ["forename", "middlename", "surname", "postcode"]


@query("SELECT id, " + ", ".join(f"nullif({_STANDARD.format(c)}, '') AS {c}" for c in _NAMES) + " FROM df")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    """Several verbs in turn, which Spark runs as one projection."""
    df = clean.standardise_white_space(at(spark, d, "df").select("id", *_NAMES), _NAMES)
    df = clean.clean_hyphens(clean.remove_punct(df, _NAMES, keep="-"), _NAMES)
    return clean.standardise_null(clean.standardise_case(df, _NAMES, "upper"), "^$", _NAMES)


@query("SELECT id, upper(forename) AS forename, lower(surname) AS surname FROM df")
def case_upper_lower(spark: SparkSession, d: str) -> DataFrame:
    return clean.standardise_case(clean.standardise_case(at(spark, d, "df"), "forename", "upper"), "surname", "lower").select("id", "forename", "surname")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS p_name FROM part")
def case_title(spark: SparkSession, d: str) -> DataFrame:
    return clean.standardise_case(at(spark, d, "part").select("p_partkey", "p_name"), "p_name", "title")


@query("SELECT id, regexp_replace(surname, '[^A-Za-z0-9 ''-]', '', 'g') AS surname, regexp_replace(CAST(load_no AS VARCHAR), '[^A-Za-z0-9 ''-]', '', 'g') AS load_no FROM df")
def punctuation(spark: SparkSession, d: str) -> DataFrame:
    return clean.remove_punct(at(spark, d, "df").select("id", "surname", "load_no"), ["surname", "load_no"], keep="-'")


@query("SELECT id, CASE WHEN length(surname) - length(replace(surname, ' ', '')) > 1 THEN replace(surname, ' ', '') ELSE surname END AS surname FROM df")
def max_space(spark: SparkSession, d: str) -> DataFrame:
    return clean.max_white_space(at(spark, d, "df").select("id", "surname"), 1, "surname")


@query("SELECT id, regexp_replace(replace(surname, ' ', '-'), '-{3,}', '--', 'g') AS surname FROM df")
def max_hyphen(spark: SparkSession, d: str) -> DataFrame:
    df = at(spark, d, "df").select("id", F.replace("surname", F.lit(" "), F.lit("-")).alias("surname"))
    return clean.max_hyphen(df, 2, "surname")


@query("SELECT id, regexp_replace(regexp_replace(surname, ' ?- ?', '-', 'g'), '^-+|-+$', '', 'g') AS surname FROM df")
def hyphens(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_hyphens(at(spark, d, "df").select("id", "surname"), "surname")


_DOUBLED = "regexp_replace(replace(forename, ' ', '  '), '(^| )(\\w)( |\\z)', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
_ENDS = f"regexp_replace(regexp_replace(regexp_replace({_DOUBLED}, '\x01 +\x01', chr(1) || chr(1), 'g'), '^ +(\x01|\\z)', '\\1'), '\x01 +\\z', chr(1))"
_SINGLE = f"regexp_replace(regexp_replace({_ENDS}, '^\x01(\\w)\x01 +(\\w)', '\\1\\2'), '(\\w|\x01) +\x01(\\w)\x01\\z', '\\1\\2')"


@query(f"SELECT id, replace(replace({_SINGLE}, chr(1), ''), '  ', ' ') AS forename FROM df")
def single_chars(spark: SparkSession, d: str) -> DataFrame:
    return clean.group_single_characters(at(spark, d, "df").select("id", "forename"), "forename", include_terminals=True)


@query(f"SELECT id, regexp_replace(upper(forename), '\\b({'|'.join(text.FORENAME_NOISE)})\\b', '', 'g') AS forename FROM df")
def forename_noise(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_forename(clean.standardise_case(at(spark, d, "df").select("id", "forename")), "forename")


@query(f"SELECT id, regexp_replace(regexp_replace(upper(surname), '\\b({'|'.join(text.SURNAME_NOISE)})\\b', '', 'g'), '\\b({'|'.join(text.SURNAME_PREFIXES)})[ -]', '\\1', 'g') AS surname FROM df")
def surname_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_surname(clean.standardise_case(at(spark, d, "df").select("id", "surname")), "surname")


@query("SELECT id, CASE sex WHEN '1' THEN 'M' WHEN '2' THEN 'F' WHEN 'U' THEN NULL ELSE sex END AS sex FROM df")
def replace_values(spark: SparkSession, d: str) -> DataFrame:
    return clean.replace(at(spark, d, "df").select("id", "sex"), "sex", {"1": "M", "2": "F", "U": None})


@query("SELECT id, CASE WHEN surname LIKE 'O''%' THEN 'O' WHEN surname LIKE 'van %' THEN 'van' ELSE surname END AS surname FROM df")
def replace_like(spark: SparkSession, d: str) -> DataFrame:
    return clean.replace(at(spark, d, "df").select("id", "surname"), "surname", {"O'%": "O", "van %": "van"}, like=True)


@query("SELECT id, CASE WHEN regexp_matches(sex, '^[1M]$') THEN 'male' WHEN regexp_matches(sex, '^[2F]$') THEN 'female' ELSE sex END AS sex FROM df")
def replace_regex(spark: SparkSession, d: str) -> DataFrame:
    return clean.replace(at(spark, d, "df").select("id", "sex"), "sex", {"^[1M]$": "male", "^[2F]$": "female"}, use_regex=True)


@query("SELECT id, coalesce(full_name, forename) AS forename FROM df LEFT JOIN (SELECT short_name, min(full_name) AS full_name FROM nicknames GROUP BY short_name) ON forename = short_name")
def replace_join(spark: SparkSession, d: str) -> DataFrame:
    rules = at(spark, d, "nicknames").groupBy("short_name").agg(F.min("full_name").alias("full_name")).collect()  # a fixed table
    return clean.replace(at(spark, d, "df").select("id", "forename"), "forename", {r.short_name: r.full_name for r in rules}, use_join=True)


@query("SELECT id, regexp_replace(regexp_replace(surname, 'Mc|Mac', 'M', 'g'), '[aeiou]+', 'a', 'g') AS surname FROM df")
def reg_replace(spark: SparkSession, d: str) -> DataFrame:
    return clean.reg_replace(at(spark, d, "df").select("id", "surname"), {"M": "Mc|Mac", "a": "[aeiou]+"}, "surname")


@query("SELECT id, CASE WHEN length(CAST(load_no AS VARCHAR)) < 3 THEN lpad(CAST(load_no AS VARCHAR), 3, '0') ELSE CAST(load_no AS VARCHAR) END AS load_no, CASE WHEN length(postcode) < 8 THEN lpad(postcode, 8, '0') ELSE postcode END AS postcode FROM df")
def leading_zeros(spark: SparkSession, d: str) -> DataFrame:
    df = clean.add_leading_zeros(at(spark, d, "df").select("id", "load_no", "postcode"), 3, "load_no")
    return clean.add_leading_zeros(df, 8, "postcode")


@query(f"""
    WITH x AS (SELECT id, forename, middlename, {_JOINED.format('forename, middlename')} AS name FROM df)
    SELECT id, CASE WHEN contains(forename, ' ') THEN split_part(name, ' ', 1) ELSE forename END AS forename,
        CASE WHEN contains(forename, ' ') THEN CASE WHEN contains(name, ' ') THEN substring(name, strpos(name, ' ') + 1) END ELSE middlename END AS middlename FROM x""")
def align_names(spark: SparkSession, d: str) -> DataFrame:
    return clean.align_forenames(at(spark, d, "df").select("id", "forename", "middlename"), "forename", "middlename")


@query("SELECT id, array_to_string(list_sort(string_split(upper(forename), '')), '') AS letters FROM df")
def alpha_name(spark: SparkSession, d: str) -> DataFrame:
    return at(spark, d, "df").select("id", text.sorted_letters(F.col("forename")).alias("letters"))


#: The letters' Soundex digits; vowels part equal digits, H and W do not.
_SOUND = "translate(regexp_replace(upper({}), '[HW]', '', 'g'), 'ABCDEFGIJKLMNOPQRSTUVXYZ', '012301202245501262301202')"
_RUNS = "{}"
for _digit in "0123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_digit}+', '{_digit}', 'g')"


@query(f"""
    WITH x AS (SELECT id, surname, upper(surname[1:1]) AS first, regexp_replace({_SOUND.format('surname[2:]')}, '[^0-9]', '0', 'g') AS rest FROM df),
    y AS (SELECT *, CASE WHEN first IN ('H', 'W') THEN '7' ELSE translate(first, 'ABCDEFGIJKLMNOPQRSTUVXYZ', '012301202245501262301202') END AS own FROM x)
    SELECT id, CASE WHEN NOT regexp_matches(first, '[A-Z]') THEN surname ELSE first || rpad(replace({_RUNS.format('own || rest')}[2:], '0', '')[1:3], 3, '0') END AS code FROM y""")
def soundex(spark: SparkSession, d: str) -> DataFrame:
    return at(spark, d, "df").select("id", phonetic.soundex(F.col("surname")).alias("code"))


@query()
def metaphone(spark: SparkSession, d: str) -> DataFrame:
    return at(spark, d, "df").select("id", phonetic.metaphone(F.col("forename")).alias("code"))


@query("SELECT id, CASE WHEN regexp_full_match(dob, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN strftime(try_strptime(dob, '%Y-%m-%d'), '%d/%m/%Y') END AS dob FROM df")
def standardise_date(spark: SparkSession, d: str) -> DataFrame:
    return clean.standardise_date(at(spark, d, "df").select("id", "dob"), "dob", "yyyy-MM-dd", "dd/MM/yyyy")


@query("SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2022-11-03') AS INTEGER) AS \"born_age_at_2022-11-03\" FROM orders")
def age_at(spark: SparkSession, d: str) -> DataFrame:
    o = at(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("born"))
    return clean.age_at(o, "born", "dd/MM/yyyy", "2022-11-03").drop("born")


# Similarity

_PAIRS = "FROM customer JOIN supplier ON c_nationkey = s_nationkey"


def _scored(f, spark: SparkSession, d: str) -> DataFrame:
    return link.pair_scores(at(spark, d, "customer"), at(spark, d, "supplier"), "c_custkey", "s_suppkey", ("c_nationkey", "s_nationkey"), ("c_name", "s_name"), f, 6)


@query(f"SELECT c_custkey, s_suppkey, round(1 - levenshtein(c_name, s_name) / greatest(length(c_name), length(s_name)), 6) AS score {_PAIRS}")
def lev_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(similarity.edit_score, spark, d)


@query(f"SELECT c_custkey, s_suppkey, round(jaro_similarity(c_name, s_name), 6) AS score {_PAIRS}")
def jaro(spark: SparkSession, d: str) -> DataFrame:
    return _scored(similarity.jaro, spark, d)


@query(f"SELECT c_custkey, s_suppkey, round(jaro_winkler_similarity(c_name, s_name), 6) AS score {_PAIRS}")
def jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return _scored(similarity.jaro_winkler, spark, d)


@query()
def seq_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _scored(similarity.sequence_ratio, spark, d)


# Flags


@query("""
    SELECT id, coalesce(sex = 'M', false) AS "FLAG_sex==M", forename = middlename AS "FLAG_forename==_middlename", postcode IS NULL AS "FLAG_postcodeisNull", dob IS NOT NULL AS "FLAG_dobisNotNull",
        regexp_matches(postcode, '^Q') AS "FLAG_inside" FROM df""")
def flags(spark: SparkSession, d: str) -> DataFrame:
    df = quality.flag(at(spark, d, "df"), "sex", "==", "M", fill_null=False)
    df = quality.flag(df, "forename", "==", column="middlename")
    df = quality.flag(quality.flag(df, "postcode", "isNull"), "dob", "isNotNull")
    return quality.flag(df, "postcode", "regex", "^Q", alias="inside").select("id", F.col("`FLAG_sex==M`"), F.col("`FLAG_forename==_middlename`"), "FLAG_postcodeisNull", "FLAG_dobisNotNull", "FLAG_inside")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    line = at(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return quality.flag(quality.flag(line, "l_quantity", ">", 45, alias="much"), "l_discount", "<=", column="l_tax", alias="dear")


_FLAGS = 'SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_quantity > 45 AS "FLAG_much", l_discount <= l_tax AS "FLAG_dear" FROM lineitem'


@query(f"""
    WITH x AS ({_FLAGS}), y AS (UNPIVOT x ON "FLAG_much", "FLAG_dear" INTO NAME flag VALUE v)
    SELECT flag, count(*) FILTER (v) AS "true", count(*) FILTER (NOT v) AS "false", count(*) AS "rows", count(*) FILTER (v) * 100.0::DOUBLE / count(*) AS percent_true, count(*) FILTER (NOT v) * 100.0::DOUBLE / count(*) AS percent_false FROM y GROUP BY flag""")
def flag_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_summary(_flagged(spark, d))


@query(f'WITH x AS ({_FLAGS}) SELECT *, CAST("FLAG_much" AS INTEGER) + CAST("FLAG_dear" AS INTEGER) AS flag_count, "FLAG_much" OR "FLAG_dear" AS "FAIL" FROM x')
def flag_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_check(_flagged(spark, d))


@query(f'WITH x AS ({_FLAGS}) SELECT *, 0 AS flag_count, false AS "FAIL" FROM x WHERE NOT ("FLAG_much" OR "FLAG_dear")')
def flag_check_pass(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_check(_flagged(spark, d), mode="pass")


# Windows


def _line(spark: SparkSession, d: str) -> DataFrame:
    return at(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")


def _windowed(mode: str, spark: SparkSession, d: str) -> DataFrame:
    return windows.window(_line(spark, d), ["l_suppkey", "l_returnflag"], "l_quantity", mode, "made")


_OVER = "SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_quantity, {} OVER (PARTITION BY l_suppkey, l_returnflag) AS made FROM lineitem"


@query(_OVER.format("count(l_quantity)"))
def window_count(spark: SparkSession, d: str) -> DataFrame:
    return _windowed("count", spark, d)


@query(_OVER.format("count(DISTINCT l_quantity)"))
def window_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _windowed("countDistinct", spark, d)


@query(_OVER.format("min(l_quantity)"))
def window_min(spark: SparkSession, d: str) -> DataFrame:
    return _windowed("min", spark, d)


@query(_OVER.format("max(l_quantity)"))
def window_max(spark: SparkSession, d: str) -> DataFrame:
    return _windowed("max", spark, d)


@query(_OVER.format("sum(l_quantity)"))
def window_sum(spark: SparkSession, d: str) -> DataFrame:
    return _windowed("sum", spark, d)


@query("SELECT * FROM df QUALIFY count(forename) OVER (PARTITION BY dob, postcode) = 2")
def filter_window_count(spark: SparkSession, d: str) -> DataFrame:
    return windows.filter_window(at(spark, d, "df"), ["dob", "postcode"], "forename", "count", 2)


@query("SELECT * EXCLUDE (n) FROM (SELECT *, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n <> 3")
def filter_window_distinct(spark: SparkSession, d: str) -> DataFrame:
    return windows.filter_window(at(spark, d, "orders"), "o_custkey", "o_orderpriority", "countDistinct", 3, False)


@query("SELECT * FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)")
def filter_window_max(spark: SparkSession, d: str) -> DataFrame:
    return windows.filter_window(at(spark, d, "orders"), "o_custkey", "o_orderdate", "max")


@query("SELECT * FROM df QUALIFY received_ts IS DISTINCT FROM min(received_ts) OVER (PARTITION BY surname)")
def filter_window_not_min(spark: SparkSession, d: str) -> DataFrame:
    return windows.filter_window(at(spark, d, "df"), "surname", "received_ts", "min", condition=False)


# Linkage

KEY_1 = (eq("c_nationkey", "s_nationkey"), eq_fn("c_name", "s_name", suffix_of(2), "last2"))
KEY_2 = (eq("c_nationkey", "s_nationkey"), eq_fn("c_name", "s_name", suffix_of(1), "last1"))
KEY_3 = (eq("c_nationkey", "s_nationkey"), score(similarity.edit_score, "c_name", "s_name", 0.6, "edit_score"))


def _keys() -> list[MatchKey]:
    return [MatchKey(*KEY_1), MatchKey(*KEY_2), MatchKey(*KEY_3)]


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return at(spark, d, "customer"), at(spark, d, "supplier")


_COND = {
    1: "c_nationkey = s_nationkey AND c_name[-2:] = s_name[-2:]",
    2: "c_nationkey = s_nationkey AND c_name[-1:] = s_name[-1:]",
    3: "c_nationkey = s_nationkey AND 1 - levenshtein(c_name, s_name) / greatest(length(c_name), length(s_name)) > 0.6",
}


def _pass_sql(k: int, before: list[int]) -> str:
    gone = "".join(f" AND NOT EXISTS (SELECT 1 FROM k{b} WHERE k{b}.c_custkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM k{b} WHERE k{b}.s_suppkey = s.s_suppkey)" for b in before)
    return f"""
    p{k} AS (SELECT DISTINCT c_custkey, s_suppkey FROM customer c JOIN supplier s ON {_COND[k]} WHERE true{gone}),
    r{k} AS (SELECT * FROM p{k} QUALIFY count(*) OVER (PARTITION BY s_suppkey) = 1),
    k{k} AS (SELECT *, {k} AS matchkey FROM r{k} QUALIFY count(*) OVER (PARTITION BY c_custkey) = 1)"""


_CASCADE = "WITH " + ",".join(_pass_sql(k, list(range(1, k))) for k in (1, 2, 3))
_LINKS = "(FROM k1 UNION ALL FROM k2 UNION ALL FROM k3)"


@query(f"WITH {_pass_sql(1, [])} FROM k1")
def matchkey_join(spark: SparkSession, d: str) -> DataFrame:
    return link.matchkey_join(*_sides(spark, d), "c_custkey", "s_suppkey", _keys()[0])


@query(f"WITH {_pass_sql(2, [])} SELECT c_custkey, s_suppkey, 2 AS matchkey FROM p2 a WHERE (SELECT count(*) FROM p2 WHERE c_custkey = a.c_custkey) = 1 AND (SELECT count(*) FROM p2 WHERE s_suppkey = a.s_suppkey) = 1")
def matchkey_join_strict(spark: SparkSession, d: str) -> DataFrame:
    return link.matchkey_join(*_sides(spark, d), "c_custkey", "s_suppkey", _keys()[1], 2, strict=True)


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return link.deterministic_linkage(*_sides(spark, d), "c_custkey", "s_suppkey", _keys())


@query(f"{_CASCADE} FROM {_LINKS}")
def deterministic_linkage(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d)


@query(f"{_CASCADE} SELECT matchkey, count(*) AS \"count\" FROM {_LINKS} GROUP BY matchkey")
def matchkey_counts(spark: SparkSession, d: str) -> DataFrame:
    return link.matchkey_counts(_cascade(spark, d))


@query("SELECT 1::BIGINT AS matchkey, '[c_nationkey=s_nationkey,last2(c_name)=last2(s_name)]' AS description UNION ALL SELECT 2, '[c_nationkey=s_nationkey,last1(c_name)=last1(s_name)]' UNION ALL SELECT 3, '[c_nationkey=s_nationkey,edit_score(c_name,s_name)>0.6]'")
def matchkey_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return matchkey_dataframe(spark, _keys())


@query("SELECT position, matchkey FROM (SELECT row_number() OVER (ORDER BY n, k) AS position, k AS matchkey FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n FROM (SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON {c})" for k, c in _COND.items()) + "))")
def order_matchkeys(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys()
    ordered = link.order_matchkeys(*_sides(spark, d), "c_custkey", "s_suppkey", keys)
    return spark.createDataFrame([(i, keys.index(k) + 1) for i, k in enumerate(ordered, 1)], "position bigint, matchkey int")


@query("SELECT * FROM df WHERE surname IS NOT NULL AND dob IS NOT NULL")
def mk_dropna(spark: SparkSession, d: str) -> DataFrame:
    return link.mk_dropna(at(spark, d, "df"), MatchKey(eq("surname"), eq("dob"), any_of(eq("forename"), eq("middlename"))))


@query("SELECT * FROM (SELECT * FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_name[-2:] = s_name[-2:]) UNION SELECT * FROM customer JOIN supplier ON c_custkey = s_suppkey")
def block_pairs(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sides(spark, d)
    c = c.withColumn("c_key", F.concat_ws("|", "c_nationkey", F.substring("c_name", -2, 2)))
    s = s.withColumn("s_key", F.concat_ws("|", "s_nationkey", F.substring("s_name", -2, 2)))
    return link.blocking(c, s, {"c_key": "s_key", "c_custkey": "s_suppkey"}, ("c_custkey", "s_suppkey")).drop("c_key", "s_key")


@query(f"{_CASCADE} SELECT matchkey, least(count(*), 5) AS n FROM {_LINKS} GROUP BY matchkey")
def clerical_sample(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sides(spark, d)
    return link.clerical_sample(_cascade(spark, d), _keys(), c, s, "c_custkey", "s_suppkey", 5).groupBy("matchkey").agg(F.count("*").alias("n"))


@query("""
    WITH RECURSIVE links AS (SELECT l_id AS a, r_id AS b FROM matchkey_join WHERE l_id <> r_id UNION SELECT r_id, l_id FROM matchkey_join WHERE l_id <> r_id),
    ids AS (SELECT l_id AS id FROM matchkey_join WHERE l_id IS NOT NULL UNION SELECT r_id FROM matchkey_join WHERE r_id IS NOT NULL),
    reached(id, least) USING KEY (id) AS (
        SELECT id, id FROM ids
        UNION
        SELECT links.b, min(reached.least) FROM reached JOIN links ON links.a = reached.id JOIN recurring.reached AS own ON own.id = links.b
        GROUP BY links.b, own.least HAVING min(reached.least) < own.least
    ), numbered AS (SELECT id, CAST(dense_rank() OVER (ORDER BY least) AS INTEGER) AS n FROM reached)
    SELECT l_id, r_id, CASE WHEN r_id IS NOT NULL THEN n END AS "Cluster_Number" FROM matchkey_join LEFT JOIN numbered ON l_id = id""")
def cluster_pairs(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_number(at(spark, d, "matchkey_join").select("l_id", "r_id"), "l_id", "r_id")


@query("SELECT * FROM df a WHERE dob IS NULL OR surname IS NULL OR NOT EXISTS (SELECT 1 FROM df b WHERE b.id <> a.id AND b.dob = a.dob AND b.surname = a.surname)")
def deduplicate_unique(spark: SparkSession, d: str) -> DataFrame:
    return link.deduplicate(at(spark, d, "df"), "id", [MatchKey(eq("dob"), eq("surname"))])[0]


@query("SELECT a.id AS id_1, b.id AS id_2 FROM df a JOIN df b ON a.dob = b.dob AND a.surname = b.surname AND a.postcode = b.postcode AND a.id < b.id")
def deduplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return link.deduplicate(at(spark, d, "df"), "id", [MatchKey(eq("dob"), eq("surname"), eq("postcode"))])[1]


def _holds(check, *args) -> bool:
    try:
        check(*args)
    except AssertionError:
        return False
    return True


@query("SELECT count(DISTINCT id) = count(*) AS id, count(DISTINCT surname) = count(surname) AS surname FROM df")
def unique_columns(spark: SparkSession, d: str) -> DataFrame:
    df = at(spark, d, "df")
    return spark.createDataFrame([(_holds(link.assert_unique, df, "id"), _holds(link.assert_unique, df, "surname"))], "id boolean, surname boolean")


@query("SELECT count(DISTINCT (l_id, r_id)) = count(*) AS pairs, false AS each FROM matchkey_join")
def unique_matches(spark: SparkSession, d: str) -> DataFrame:
    m = at(spark, d, "matchkey_join")
    return spark.createDataFrame([(_holds(link.assert_unique, m, ["l_id", "r_id"]), _holds(link.assert_unique_matches, m, "l_id", "r_id"))], "pairs boolean, each boolean")


@query("SELECT unnest(['c_nationkey', 'c_name']) AS left_column, unnest(['s_nationkey', 's_name']) AS right_column")
def matchkey_columns(spark: SparkSession, d: str) -> DataFrame:
    key = _keys()[0]
    return spark.createDataFrame(list(zip(key.columns("left"), key.columns("right"))), "left_column string, right_column string")


# Profiles


@query("""
    WITH x AS (SELECT * FROM (SELECT CAST(id AS VARCHAR) AS id, forename, middlename, surname, dob, sex, postcode, CAST(load_no AS VARCHAR) AS load_no, CAST(received_ts AS VARCHAR) AS received_ts FROM df) UNPIVOT INCLUDE NULLS (v FOR variable IN (id, forename, middlename, surname, dob, sex, postcode, load_no, received_ts)))
    SELECT variable, CASE variable WHEN 'id' THEN 'bigint' WHEN 'load_no' THEN 'int' WHEN 'received_ts' THEN 'timestamp_ntz' ELSE 'string' END AS type, count(*) AS "count", count(DISTINCT v) AS "distinct", count(DISTINCT v) * 100.0::DOUBLE / count(*) AS percent_distinct,
        count(*) - count(v) AS "null", (count(*) - count(v)) * 100.0::DOUBLE / count(*) AS percent_null, count(v) AS not_null, count(v) * 100.0::DOUBLE / count(*) AS percent_not_null FROM x GROUP BY variable""")
def describe_metrics(spark: SparkSession, d: str) -> DataFrame:
    return profile.describe_metrics(at(spark, d, "df"))


_TEXT_PROFILE = "SELECT '{0}' AS variable, 'string' AS type, count(*) AS row_count, count(DISTINCT {0}) AS \"distinct\", count(DISTINCT {0}) * 100.0::DOUBLE / count(*) AS percent_distinct, count(*) - count({0}) AS \"null\", (count(*) - count({0})) * 100.0::DOUBLE / count(*) AS percent_null, count({0}) AS not_null, count({0}) * 100.0::DOUBLE / count(*) AS percent_not_null, count(*) FILTER (regexp_full_match({0}, '\\s*')) AS \"empty\", count(*) FILTER (regexp_full_match({0}, '\\s*')) * 100.0::DOUBLE / count(*) AS percent_empty, CAST(NULL AS VARCHAR) AS min, CAST(NULL AS VARCHAR) AS max, min(length({0})) AS min_l, max(length({0})) AS max_l, CAST(NULL AS BIGINT) AS max_l_before_point, CAST(NULL AS BIGINT) AS min_l_before_point, CAST(NULL AS BIGINT) AS max_l_after_point, CAST(NULL AS BIGINT) AS min_l_after_point FROM df"


@query(" UNION ALL ".join(_TEXT_PROFILE.format(c) for c in ("forename", "middlename", "surname", "dob", "sex", "postcode")))
def df_describe(spark: SparkSession, d: str) -> DataFrame:
    return profile.df_describe(at(spark, d, "df").select("forename", "middlename", "surname", "dob", "sex", "postcode"))


_DIGITS = "length(split_part(CAST(c_acctbal AS VARCHAR), '.', 1))", "greatest(length(rtrim(split_part(CAST(c_acctbal AS VARCHAR), '.', 2), '0')), 1)"


@query(f"SELECT 'c_acctbal' AS variable, count(DISTINCT c_acctbal) AS \"distinct\", CAST(min(c_acctbal) AS VARCHAR) AS min, CAST(max(c_acctbal) AS VARCHAR) AS max, max({_DIGITS[0]}) AS max_l_before_point, min({_DIGITS[0]}) AS min_l_before_point, max({_DIGITS[1]}) AS max_l_after_point, min({_DIGITS[1]}) AS min_l_after_point FROM customer")
def df_describe_numbers(spark: SparkSession, d: str) -> DataFrame:
    made = profile.df_describe(at(spark, d, "customer").select("c_acctbal"))
    return made.select("variable", "distinct", "min", "max", "max_l_before_point", "min_l_before_point", "max_l_after_point", "min_l_after_point")


_COUNTS = """
    WITH x AS (SELECT * FROM (SELECT forename, surname, sex FROM df) UNPIVOT INCLUDE NULLS (value FOR variable IN (forename, surname, sex))),
    y AS (SELECT variable, value, count(*) AS "count" FROM x {} GROUP BY ALL)
    SELECT variable, CAST(row_number() OVER (PARTITION BY variable ORDER BY "count" {}, value NULLS FIRST) AS INTEGER) AS rank, value, "count" FROM y QUALIFY rank <= 20"""


@query(_COUNTS.format("", "DESC"))
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(at(spark, d, "df").select("forename", "surname", "sex"))


@query(_COUNTS.format("WHERE value IS NOT NULL", "ASC"))
def value_counts_low(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(at(spark, d, "df").select("forename", "surname", "sex"), include_null=False, lowest=True)


@query("""
    WITH x AS (SELECT row_number() OVER (ORDER BY count(*) DESC, sex NULLS FIRST) AS rank, sex, count(*) AS n FROM df GROUP BY sex)
    SELECT CASE WHEN x.rank IS NULL THEN '' ELSE sex END AS sex, coalesce(n, 0) AS sex_count FROM range(1, 21) r(rank) LEFT JOIN x USING (rank)""")
def value_counts_wide(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts_wide(at(spark, d, "df").select("sex"))


@query("SELECT name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (regexp_matches({c}, '[0-9]')) / count(*) AS part FROM df" for c in ("forename", "surname", "dob", "sex", "postcode")) + ") WHERE part >= 0.75")
def regex_match(spark: SparkSession, d: str) -> DataFrame:
    names = profile.regex_match(at(spark, d, "df").select("forename", "surname", "dob", "sex", "postcode"), "[0-9]", limit=None)
    return spark.createDataFrame([(n,) for n in names], "name string")


# Disclosure

@query("""
    WITH x AS (SELECT o_orderkey, exp(o_totalprice / 60000.0) AS v FROM orders), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x)
    SELECT o_orderkey, CASE WHEN v < a - 1.5 * (b - a) THEN 'lower' ELSE 'upper' END AS side FROM x, q WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)""")
def outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    o = at(spark, d, "orders").select("o_orderkey", F.exp(F.col("o_totalprice") / 60000.0).alias("v"))
    return disclosure.numerical_outliers(o, "v").select("o_orderkey", F.substring("Outlier", 1, 5).alias("side"))


@query("SELECT c_custkey, c_acctbal, round(p, 6) AS \"0.9_percentile_value\" FROM customer, (SELECT quantile_cont(c_acctbal, 0.9) AS p FROM customer) WHERE c_acctbal > p")
def percentile_cut(spark: SparkSession, d: str) -> DataFrame:
    made = disclosure.numerical_percentiles(at(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "greater", "0.9")
    return made.withColumn("0.9_percentile_value", F.round("`0.9_percentile_value`", 6))


@query("""
    WITH x AS (SELECT id, dob, regexp_replace(dob, '[^0-9]', '', 'g') AS n FROM df), y AS (SELECT *, length(n) = 8 AND regexp_full_match(n[5:6], '0[1-9]|1[0-2]') AS good FROM x)
    SELECT id, CASE WHEN good THEN n[1:4] WHEN dob IS NOT NULL THEN 'input_error' END AS dob_year,
        CASE WHEN good THEN 'Q' || CAST(CAST(ceil(CAST(n[5:6] AS INTEGER) / 3) AS INTEGER) AS VARCHAR) WHEN dob IS NOT NULL THEN 'input_error' END AS dob_year_quarter FROM y""")
def year_quarter(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.date_year_quarter(at(spark, d, "df").select("id", "dob"), "dob")


_CODE = "regexp_replace(postcode, '[^A-Za-z0-9]', '', 'g')"


def _postcode(level: str, spark: SparkSession, d: str) -> DataFrame:
    return disclosure.postcode_level(at(spark, d, "df").select("id", "postcode"), "postcode", level)


@query(f"SELECT id, regexp_extract({_CODE}, '^[^0-9]*') AS postcode_area FROM df")
def postcode_area(spark: SparkSession, d: str) -> DataFrame:
    return _postcode("area", spark, d)


@query(f"SELECT id, {_CODE}[1:greatest(length({_CODE}) - 3, 0)] AS postcode_district FROM df")
def postcode_district(spark: SparkSession, d: str) -> DataFrame:
    return _postcode("district", spark, d)


@query(f"SELECT id, {_CODE}[1:greatest(length({_CODE}) - 2, 0)] AS postcode_sector FROM df")
def postcode_sector(spark: SparkSession, d: str) -> DataFrame:
    return _postcode("sector", spark, d)


def _first_fit(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in disclosure.IDENTIFIERS.items()) + f" END AS {c}_identifier"


@query(f"SELECT *, {', '.join(map(_first_fit, ('l_id', 'uprn', 'date_of_birth')))} FROM (SELECT DISTINCT l_id, uprn, date_of_birth FROM df_l) WHERE coalesce(l_id, uprn, date_of_birth) IS NOT NULL")
def identifying_strings(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.identifying_strings(at(spark, d, "df_l").select("l_id", "uprn", "date_of_birth"))[0]


@query("SELECT 'Uprn' AS missing_variable")
def lacking_variables(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.check_variables(spark, at(spark, d, "df"), ["ID", "Forename", "Uprn"])[0]


@query("SELECT 'load_no' AS unapproved_variable UNION ALL SELECT 'received_ts'")
def check_variables(spark: SparkSession, d: str) -> DataFrame:
    return disclosure.check_variables(spark, at(spark, d, "df"), ["ID", "Forename", "Middlename", "Surname", "DOB", "Sex", "Postcode", "Uprn"])[1]


@query("SELECT * FROM supplier")
def read_parquet(spark: SparkSession, d: str) -> DataFrame:
    return files.read_format(spark, "parquet", d, "supplier.parquet")




def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, path = at(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), _scratch(spark)
    files.write_format(rows, "csv", path, "orders", sep="|")
    return files.read_format(spark, "csv", path, "orders", sep="|", schema=rows.schema)


@query("SELECT l_id, first_name, last_name, date_of_birth, uprn FROM df_l")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    files.write_format(at(spark, d, "df_l").select("l_id", "first_name", "last_name", "date_of_birth", "uprn"), "parquet", path, "df_l")
    return files.read_format(spark, "parquet", path, "df_l")


@query("SELECT * FROM (VALUES ('first'), ('second')) t(name)")
def listed_files(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    for name in ("first", "second", "other"):
        files.write_format(at(spark, d, "region"), "parquet", path, name)
    return spark.createDataFrame([(n,) for n in files.list_files(spark, path, regex="st$|nd$", full_path=False)], "name string")


@query("SELECT * FROM (VALUES ('a', true, 'int'), ('b', true, 'int'), ('c', false, NULL)) t(name, there, key_type)")
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A table is created, cloned, renamed and dropped; what the catalogue says of it."""
    start = f"kinweave_{uuid.uuid4().hex[:8]}_"
    catalog.create_hive_table(at(spark, d, "region").select("r_regionkey", "r_name"), "default", f"{start}a")
    catalog.clone_hive_table(spark, "default", f"{start}a", start, "c")
    catalog.rename_hive_table(spark, "default", f"{start}c", f"{start}b")
    there = [t.removeprefix(start) for t in catalog.list_tables(spark, "default") if t.startswith(start)]
    rows = [(t, t in there, dict(catalog.hive_dtypes(spark, "default", start + t)).get("r_regionkey") if t in there else None) for t in "abc"]
    for t in there:
        catalog.drop_hive_table(spark, "default", start + t)
    return spark.createDataFrame(rows, "name string, there boolean, key_type string")


@query("SELECT * FROM (VALUES ('r_name', 'string', ''), ('r_regionkey', 'int', 'int')) t(variable, a, b)")
def variable_matrix(spark: SparkSession, d: str) -> DataFrame:
    start = f"kinweave_{uuid.uuid4().hex[:8]}_"
    r = at(spark, d, "region")
    catalog.create_hive_table(r.select("r_regionkey", "r_name"), "default", f"{start}a")
    catalog.create_hive_table(r.select("r_regionkey"), "default", f"{start}b")
    rows = [tuple(x) for x in catalog.hive_variable_matrix(spark, "default", start).select("variable", f"{start}a", f"{start}b").collect()]  # a row for each variable
    made = catalog.create_table_statements(spark, "default", start).count()
    for t in "ab":
        catalog.drop_hive_table(spark, "default", start + t)
    if made != 2:
        raise AssertionError("a statement for each table")
    return spark.createDataFrame(rows, "variable string, a string, b string")
