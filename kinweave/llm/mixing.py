"""Mixing of sources to target shares of the total size, with a cap on how often a document may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .tokens import count_tokens

MAX_SOURCES = 100_000


def mixing_rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, exact_shares: bool = False) -> DataFrame:
    """One row for each source of ``targets``, with its ``rate``: how often its documents are used on average.

    The total is ``total_tokens``, or all tokens of the sources that have documents and a target. A source whose target
    asks for more than ``max_repeats`` uses of each document gives that many and falls short by ``short_tokens``; the other
    sources keep their rates, so they stay in proportion to each other and no document is left out to make shares fit.
    With ``exact_shares`` the total is the largest for which no source falls short, which the scarcest source decides, or
    ``total_tokens`` if that is less. Sources without tokens, or without a positive share and cap, give nothing: the other targets are scaled to sum
    to 1. Rows that repeat a source count as one, with the sum of their shares and the smallest cap.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    t = wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    share = F.when(usable, F.col("target_share"))
    most = F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("target_share")))
    of = t.agg(F.sum(share).alias("all_shares"), F.sum(F.when(usable, F.col("tokens"))).cast("double").alias("all_tokens"), most.alias("most"))  # one row
    largest = F.col("most") * F.col("all_shares")
    total = (largest if exact_shares else F.col("all_tokens")) if total_tokens is None else F.lit(float(total_tokens))
    if exact_shares:
        total = F.least(total, largest)
    wish = F.coalesce(total * share / F.col("all_shares"), F.lit(0.0))
    rate = F.when(usable, F.least(wish / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    made = t.crossJoin(F.broadcast(of)).select(*t.columns, rate.alias("rate"), wish.alias("wish"))
    return made.select(*t.columns, "rate", F.when((F.col("wish") > 0) & (F.col("rate") >= F.col("max_repeats")), F.greatest(F.col("wish") - F.col("rate") * F.col("tokens"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("short_tokens"))


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 17, total_tokens: float | None = None, exact_shares: bool = False, ranks: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix, ``(id, source, copy_no, n_tokens)`` with a row for each use of a document, and the report on its shares.

    A document is used floor(rate) times and once more with the probability of the remainder, decided by a hash of its
    id and ``seed``; so never more than ``max_repeats`` times. Documents of a null source, or of one without target,
    are not used; null and empty texts have no tokens but count as documents; targets of sources without documents are
    reported with a share reached of 0; ``short_tokens`` says what a capped source lacks (see :func:`mixing_rates`).
    ``targets`` is checked to be small before it is broadcast.
    """
    if targets.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    named = F.broadcast(targets.where("source is not null").select("source").distinct())
    sizes = materialise(count_tokens(docs.select(id_col, "source", "text").join(named, "source", "left_semi"), [id_col, "source"], ranks=ranks))
    rates = materialise(mixing_rates(sizes, targets, total_tokens, exact_shares))
    draw = (F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    times = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    uses = sizes.join(F.broadcast(rates.select("source", "rate")), "source").withColumn("times", times).where("times > 0")
    mix = uses.select(id_col, "source", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy_no"), "n_tokens")
    got = uses.groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("mix_tokens"), F.sum("times").alias("mix_docs"), F.max("times").alias("most_uses"))
    report = rates.join(got, "source", "left").na.fill(0, ["mix_tokens", "mix_docs", "most_uses"])
    total = report.agg(F.sum("mix_tokens").alias("total"))
    reached = F.coalesce(F.try_divide(F.col("mix_tokens"), F.col("total")), F.lit(0.0))
    return mix, report.crossJoin(F.broadcast(total)).select("source", "target_share", reached.alias("reached_share"), "max_repeats", "most_uses", "rate", "short_tokens", "n_docs", "tokens", "mix_docs", "mix_tokens")
