"""Shares and agreement of contributions: long tables of (id, feature, contribution)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.rowwise import block_of


def attribution_share(contributions: DataFrame, day: str, id: str, k: int = 3) -> DataFrame:
    """By day: the mass of named and of anonymous features, the named share, and the share of rows with a named one
    among their k largest positive contributions. Contributions are those of flagged rows."""
    named = block_of(F.col("feature")) == "named"
    mass = F.abs("contribution")
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("contribution") > 0, F.struct((-F.col("contribution")).alias("c"), "feature")))), 1, k)
    rows = contributions.groupBy(day, id).agg(F.sum(F.when(named, mass)).alias("named"), F.sum(F.when(~named, mass)).alias("anonymous"), top.alias("top"))
    has = F.exists("top", lambda x: block_of(x["feature"]) == "named")
    g = rows.groupBy(day).agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("named"), F.coalesce(F.sum("anonymous"), F.lit(0.0)).alias("anonymous"), F.avg(has.cast("double")).alias("rows_with_named"))
    return g.withColumn("named_share", F.try_divide(F.col("named"), F.col("named") + F.col("anonymous")))


def reason_code_share(codes: DataFrame, flagged: DataFrame, id: str) -> DataFrame:
    """Over all flagged rows: the codes, the share of named ones, and the share of rows that have a code."""
    per = codes.groupBy(id).agg(F.count(F.lit(1)).alias("n"), F.count_if(block_of(F.col("feature")) == "named").alias("named"))
    rows = flagged.select(id).join(per, id, "left")
    return rows.agg(F.count(F.lit(1)).alias("flagged"), F.coalesce(F.sum("n"), F.lit(0)).alias("codes"), F.try_divide(F.sum("named"), F.sum("n")).alias("named_share"), F.avg(F.col("n").isNotNull().cast("double")).alias("coverage"))


def two_block(contributions: DataFrame, id: str) -> DataFrame:
    """By block: the mean |sum| and the mean sum of |.| a row that it has, and how much of the latter cancels."""
    net = contributions.groupBy(id, block_of(F.col("feature")).alias("block")).agg(F.abs(F.sum("contribution")).alias("net"), F.sum(F.abs("contribution")).alias("gross"))
    g = net.groupBy("block").agg(F.avg("net").alias("net"), F.avg("gross").alias("gross"))
    return g.withColumn("cancellation", 1 - F.try_divide("net", "gross"))


def group_sums(contributions: DataFrame, group: Column, id: str) -> DataFrame:
    """(id, grp, part): each row's contributions by group."""
    return contributions.groupBy(id, group.alias("grp")).agg(F.sum("contribution").alias("part"))


def reconstruction(contributions: DataFrame, group: Column, id: str, limit: float = 1e-4, stored: DataFrame | None = None) -> DataFrame:
    """Whether the groups' sums, those of a stored table (id, grp, part) if given, add up to each row's total: rows of
    either, and those off by more than the limit, which a row of one alone is too."""
    sums = (stored if stored is not None else group_sums(contributions, group, id)).groupBy(id).agg(F.sum("part").alias("parts"))
    whole = contributions.groupBy(id).agg(F.sum("contribution").alias("whole"))
    both = whole.join(sums, id, "full")
    off = F.coalesce(F.abs(F.col("whole") - F.col("parts")) > limit, F.lit(True))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(off).alias("off"))


def rank_agreement(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """a, b: (feature, importance), a row a feature. Spearman's correlation with average ranks, and common top ones."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        w, same = Window.orderBy(F.desc("importance")), Window.partitionBy("importance")
        average = F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0
        place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
        return df.select("feature", average.alias(f"r_{name}"), place.alias(f"k_{name}"))

    both = ranked(a, "a").join(ranked(b, "b"), "feature")
    common = F.count_if((F.col("k_a") <= top) & (F.col("k_b") <= top)).alias("common_top")
    return both.agg(F.count(F.lit(1)).alias("features"), F.corr("r_a", "r_b").alias("spearman"), common)


def linear_contributions(df: DataFrame, id: str, weights: dict[str, float]) -> DataFrame:
    """weight * (x - mean) of each feature as long rows; null features contribute nothing. Means come from df."""
    means = df.agg(*(F.avg(c).alias(c) for c in weights)).first()
    parts = [F.struct(F.lit(c).alias("feature"), F.coalesce(w * (F.col(c) - (means[c] or 0.0)), F.lit(0.0)).alias("contribution")) for c, w in weights.items()]
    return df.select(id, F.inline(F.array(*parts)))
