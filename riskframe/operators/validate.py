"""Validation of feature tables and reports on them: shares, contracts, subsets, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import feature_family
from riskframe.operators.profile import missing_share


def long(df: DataFrame, wide: dict[str, Column]) -> DataFrame:
    """One row of aggregates as (feature, value)."""
    row = df.agg(*(c.alias(name) for name, c in wide.items()))
    return row.unpivot([], list(wide), "feature", "value")


def unseen_share(df: DataFrame, columns: list[str], split: str = "split", unseen: int = -1) -> DataFrame:
    """(split, feature, unseen_share) of encoded columns, where some rows hold a category that training did not see."""
    shares = [F.avg((F.col(c) == unseen).cast("double")).alias(c) for c in columns]
    wide = df.where(F.col(split).isNotNull()).groupBy(split).agg(*shares)
    return wide.unpivot([split], columns, "feature", "unseen_share").where("unseen_share > 0")


def missing_drift(before: DataFrame, after: DataFrame, columns: list[str], limit: float = 0.25) -> DataFrame:
    """(feature, before, after, delta): features whose missing share moved by more than the limit."""
    a, b = (missing_share(d, columns).withColumnRenamed("missing", n) for d, n in ((before, "before"), (after, "after")))
    return a.join(b, "feature").withColumn("delta", F.abs(F.col("after") - F.col("before"))).where(F.col("delta") > limit)


def choose_monitored(ranking: DataFrame, missing: DataFrame, n: int, most_missing: float = 0.3) -> DataFrame:
    """The n most important features of (feature, importance) whose missing share is within the limit, ties by name."""
    fit = missing.where(F.col("missing") <= most_missing)
    return ranking.join(fit, "feature").orderBy(F.desc("importance"), "feature").limit(n)


def family_counts(names: DataFrame) -> DataFrame:
    """Features, (feature), by family."""
    return names.groupBy(feature_family(F.col("feature")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def reduction_table(blocks: DataFrame, kept: list[str]) -> DataFrame:
    """By block of columns with equal null counts: how many there are, and how many a reduction kept."""
    held = F.size(F.array_intersect("features", F.array(*(F.lit(c) for c in kept)).cast("array<string>")))
    return blocks.select("missing", F.size("features").alias("columns"), held.alias("retained"))


def contract_diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """What keeps two ordered feature contracts from being the same: (feature, what is wrong). Empty if nothing is."""
    out = [(c, "only in the first") for c in a if c not in b] + [(c, "only in the second") for c in b if c not in a]
    return out or [(x, f"stands where the second has {y}") for x, y in zip(a, b, strict=True) if x != y]


def leaked_keys(log: DataFrame, sealed: DataFrame, key: str) -> DataFrame:
    """Keys of a sealed table that are in a log."""
    return log.select(key).intersect(sealed.select(key))


def with_exists_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """1 where the other table has the row's key, else 0; no row is doubled."""
    known = other.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(1))
    return df.join(known, key, "left").withColumn(name, F.coalesce("_known", F.lit(0))).drop("_known")


def feature_select(df: DataFrame, keep: list[str], retained: list[str], constant: list[str], drops: list[str]) -> DataFrame:
    """`keep` first, then the features: no key, label, time, day, anchor source or constant column, and of the
    numbered block (v1, v2, ...) the retained ones alone."""
    gone = {*keep, *constant, *drops}
    block = lambda c: c[:1] == "v" and c[1:].isdigit()
    return df.select(*keep, *(c for c in df.columns if c not in gone and (not block(c) or c in retained)))


def worked_cases(df: DataFrame, id: str, y: str, p: str, flag: str, amount: str) -> DataFrame:
    """(kind, id): the true positive of the highest score, and the false positive and negative of the highest amount."""
    hit, review = F.col(y) == 1, F.col(flag) == 1
    kinds = {"true_positive": (hit & review, p), "false_positive": (~hit & review, amount), "false_negative": (hit & ~review, amount)}
    # The largest value, ties to the smallest id: the order is (value, -id).
    best = [F.max_by(F.when(c, F.col(id)), F.when(c, F.struct(F.col(by), -F.col(id)))).alias(k) for k, (c, by) in kinds.items()]
    return df.agg(*best).unpivot([], list(kinds), "kind", id).where(F.col(id).isNotNull())


def compact_sets(ranking: DataFrame, sizes: list[int]) -> DataFrame:
    """(k, rank, feature): the k most important features for each k; of a ranking with one row a feature."""
    top = ranking.orderBy(F.desc("importance"), "feature").limit(max(sizes))
    numbered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature"))).alias("f"))
    each = numbered.select(F.posexplode("f").alias("place", "f")).select((F.col("place") + 1).alias("rank"), F.col("f.feature").alias("feature"))
    ks = F.array(*(F.lit(k) for k in sizes))
    return each.withColumn("k", F.explode(ks)).where("rank <= k").select("k", "rank", "feature")


def sample_order(key: str, seed: int) -> Column:
    """A fixed order of rows by a hash of their key and a seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same ones in each run: those first by a hash of key and seed."""
    return df.orderBy(sample_order(key, seed), key).limit(n)


def ranked(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k rows with the highest values, ties by another column."""
    return df.orderBy(F.desc_nulls_last(by), tie).limit(k)


def operating_point(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """One row: n, flagged, review_rate, precision, recall at a threshold."""
    flag, hit = (F.col(p) >= threshold), F.col(y) == 1
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"), F.count_if(flag & hit).alias("tp"), F.count_if(hit).alias("positives"))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return g.select("n", "flagged", rate("flagged", "n").alias("review_rate"), rate("tp", "flagged").alias("precision"), rate("tp", "positives").alias("recall"))
