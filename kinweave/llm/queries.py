"""Registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .format_duplicates import duplicate_counts, format_duplicates
from .group_pairs import group_pairs
from .lookalikes import visually_identical, visually_identical_groups
from .mixing import mix_sources, mixing_rates
from .name_variants import name_variants, variant_pairs
from .source_linkage import MATCH, Source, link_sources
from .tokens import encode_texts

RECORD_FIELDS = ["dob", "postcode", "surname", "sex", "forename", "middlename"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_duplicates(table(spark, sf_dir, "df"), "id", RECORD_FIELDS, ("forename", "middlename"))
    return found.where("member_id <> keep_id").select("keep_id", F.col("member_id").alias("copy_id"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_counts(table(spark, sf_dir, "df"), "id", RECORD_FIELDS, ("forename", "middlename"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(name_variants(table(spark, sf_dir, "df"), table(spark, sf_dir, "nicknames")))


def p4_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants(table(spark, sf_dir, "df"), table(spark, sf_dir, "nicknames")).select("id", F.col("person").alias("person_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(table(spark, sf_dir, "matchkey_join"), "l_id", "r_id")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_sources(Source(table(spark, sf_dir, "df_l"), "l_id"), Source(table(spark, sf_dir, "df_r"), "r_id"), table(spark, sf_dir, "nicknames"))[0]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).where(F.col("confidence") >= MATCH).select("l_id", "r_id")


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates for sizes in characters, which SQL can check."""
    sizes = table(spark, sf_dir, "documents").where("source is not null").select("source", F.coalesce("n_chars", F.lit(0)).alias("n_tokens"))
    rates = mixing_rates(sizes, table(spark, sf_dir, "mix_targets"))
    return rates.select("source", "target_share", "max_repeats", "n_docs", F.col("tokens").alias("chars"), F.round("rate", 6).alias("rate"), F.round("short_tokens", 3).alias("short_chars"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visually_identical(table(spark, sf_dir, "documents"))


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visually_identical_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p4_found, p4_persons, p5_found, p6_found, p6_confidence, p7_ids, p8_mix, p8_shares, p8_rates, p9_found, p9_groups)}

_CLEAN = {k: f"coalesce(lower(regexp_replace({k}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '')" for k in RECORD_FIELDS}
_CANONICAL = f"""concat_ws(chr(1), {_CLEAN["dob"]}, {_CLEAN["postcode"]}, {_CLEAN["surname"]}, {_CLEAN["sex"]},
    least({_CLEAN["forename"]}, {_CLEAN["middlename"]}), greatest({_CLEAN["forename"]}, {_CLEAN["middlename"]}))"""

SQL: dict[str, str] = {
    "p1_found": f"SELECT keep_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY {_CANONICAL}) AS keep_id FROM df) WHERE id <> keep_id",
    "p5_found": """
        WITH RECURSIVE links AS (SELECT l_id AS a, r_id AS b FROM matchkey_join WHERE l_id <> r_id UNION SELECT r_id, l_id FROM matchkey_join WHERE l_id <> r_id),
        ids AS (SELECT l_id AS id FROM matchkey_join WHERE l_id IS NOT NULL UNION SELECT r_id FROM matchkey_join WHERE r_id IS NOT NULL),
        reached(id, least) USING KEY (id) AS (
            SELECT id, id FROM ids
            UNION
            SELECT links.b, min(reached.least) FROM reached JOIN links ON links.a = reached.id JOIN recurring.reached AS own ON own.id = links.b
            GROUP BY links.b, own.least HAVING min(reached.least) < own.least
        )
        SELECT least AS group_id, id AS record_id FROM reached""",
    "p1_groups": f"SELECT min(id) AS keep_id, count(*) AS n_copies FROM df GROUP BY {_CANONICAL}",
    "p8_rates": """
        WITH t AS (
            SELECT source, target_share, max_repeats, count(doc_id) AS n_docs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars
            FROM mix_targets LEFT JOIN documents USING (source) GROUP BY ALL
        ), w AS (
            SELECT *, CASE WHEN chars > 0 THEN target_share * (SELECT sum(chars) FROM t) / (SELECT sum(target_share) FROM t WHERE chars > 0) ELSE 0.0 END AS wish FROM t
        )
        SELECT source, target_share, max_repeats, n_docs, chars, round(CASE WHEN chars > 0 THEN least(wish / chars, max_repeats) ELSE 0.0 END, 6)::DOUBLE AS rate,
            round(CASE WHEN chars > 0 AND wish / chars >= max_repeats THEN wish - max_repeats * chars ELSE 0.0 END, 3)::DOUBLE AS short_chars FROM w""",
}
