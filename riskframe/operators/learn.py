"""Learning with pyspark.ml: preparation inside each fit, oversampling of the training side only, folds, calibration.

Every fitted number (medians, deviations, neighbours, coefficients) comes from the training rows of its fold. Nulls
become the training median and a flag that says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import apply_calibrator, in_days
from riskframe.operators import calibrate
from riskframe.operators.neighbours import nearest
from riskframe.operators.ordered import quantiles
from riskframe.operators.rank_metrics import ranking_metrics
from riskframe.operators.split import Fold
from riskframe.operators.trees import read_trees, tree_contributions
from riskframe.sources.io import written


@dataclass(frozen=True)
class Arm:
    """A model and how it meets the imbalance: weighted, oversampled to a ratio, both, or neither."""

    model: str  # "logreg" or "gbt"
    weighted: bool = False
    ratio: float | None = None
    strength: float = 1e-3  # of the L2 penalty, or the learning rate of trees
    trees: int = 10
    depth: int = 4
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or "_".join([self.model, *["smote"] * (self.ratio is not None), *["weighted"] * self.weighted, *["natural"] * (self.ratio is None and not self.weighted)])


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """df as a table dealt evenly over tasks by its key, in order: each pass of a fit reads it again, with as many tasks
    as the cluster has cores, however few pieces the source has, and in the same order in each run."""
    return written(df.repartition(key).sortWithinPartitions(key), "rows")


@dataclass(frozen=True)
class Preparation:
    """Training medians, means and deviations by feature, and which features have nulls in training (None: any may).

    A flag that is the same for all training rows teaches a model nothing, so that no model gets it.
    """

    numbers: dict[str, tuple[float, float, float]]
    gaps: frozenset[str] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Features filled and standardised, and <feature>_missing: 1 where they were null."""
        flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in self.numbers}
        scaled = {c: (F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / (std or 1.0) for c, (median, mean, std) in self.numbers.items()}
        return df.withColumns(flags).withColumns(scaled)

    def of(self, features: list[str]) -> Preparation:
        """That of some of the features, in their order: each has its numbers from its own column alone."""
        return Preparation({c: self.numbers[c] for c in features}, self.gaps)

    @property
    def columns(self) -> list[str]:
        return [*self.numbers, *(f"{c}_missing" for c in self.numbers if self.gaps is None or c in self.gaps)]


def prepare(train: DataFrame, features: list[str]) -> Preparation:
    long = train.select(*(F.col(c).cast("double").alias(c) for c in features)).unpivot([], features, "feature", "x")
    medians = {r["feature"]: r["value"] for r in quantiles(long, ["feature"], "x", [0.5]).collect()}
    filled = F.coalesce("x", F.element_at(F.create_map(*(F.lit(v) for c in features for v in (c, medians.get(c, 0.0)))), F.col("feature")))
    spread = long.withColumn("filled", filled).groupBy("feature").agg(F.avg("filled").alias("m"), F.stddev_pop("filled").alias("s"), F.count_if(F.col("x").isNull()).alias("gaps")).collect()
    gaps = frozenset(r["feature"] for r in spread if r["gaps"])
    return Preparation({r["feature"]: (medians.get(r["feature"], 0.0), r["m"], r["s"]) for r in sorted(spread, key=lambda r: features.index(r["feature"]))}, gaps)


def uniform(*parts) -> F.Column:
    """A number in [0, 1) by a hash of columns and literals, the same in each run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def neighbours(df: DataFrame, key: str, y: str, features: list[str], k: int = 5) -> DataFrame:
    """nearest() of the minority (y = 1), which does not depend on the ratio."""
    return nearest(df.where(F.col(y) == 1).select(F.col(key).alias("key"), F.array(*(F.col(c).cast("double") for c in features)).alias("x")), k)


def smote(df: DataFrame, key: str, y: str, features: list[str], ratio: float, k: int = 5, seed: int = 0, near: DataFrame | None = None) -> DataFrame:
    """df (key, y, features without nulls) and synthetic rows of the minority (y = 1), with a null key.

    They bring the minority to about `ratio` of the majority: each minority row gives floor(q) or floor(q) + 1 of
    them, by a hash. Each lies between its row and one of the row's k nearest neighbours in the whole minority, both
    chosen by hashes. Without a minority, or where it is large enough, df as it is. near: neighbours() of df, if they
    are known.
    """
    n = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    want = ratio * n[1] / n[0] - 1 if n[0] else 0.0
    if want <= 0 or n[0] < 2:
        return df
    kind = df.schema[key].dataType.simpleString()
    copies = F.floor(F.lit(want)) + (uniform(F.col("key"), F.lit(f"n{seed}")) < want - int(want)).cast("long")
    rows = (neighbours(df, key, y, features, k) if near is None else near).withColumn("copies", copies).where("copies > 0 AND size(near) > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("j"))
    place = F.floor(uniform(F.col("key"), F.col("j"), F.lit(f"p{seed}")) * F.size("near")).cast("int")
    rows = rows.withColumns({"other": F.get("near", place), "u": uniform(F.col("key"), F.col("j"), F.lit(f"u{seed}"))})
    made = [(F.col("x")[i] + F.col("u") * (F.col("other")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(features)]
    made = written(rows.select(F.lit(None).cast(kind).alias(key), F.lit(1).cast(df.schema[y].dataType).alias(y), *made), "made")
    return df.select(key, y, *(F.col(c).cast("double").alias(c) for c in features)).unionByName(made)


@dataclass(frozen=True)
class Fitted:
    """A preparation and a model; score() adds p."""

    preparation: Preparation
    model: object

    def explain(self, df: DataFrame, id: str) -> tuple[DataFrame, float]:
        """((id, feature, contribution), base) of a model of trees, in log-odds; a feature and its missing flag are one."""
        found = read_trees(self.model)
        names = [c.removesuffix("_missing") if c not in self.preparation.numbers else c for c in self.preparation.columns]
        return tree_contributions(self.preparation.apply(df.select(id, *self.preparation.numbers)), id, self.preparation.columns, found, names), found.base

    def score(self, df: DataFrame, p: str = "p") -> DataFrame:
        prepared = self.preparation.apply(df.withColumn("_row", F.struct(*df.columns)))
        scored = self.model.transform(VectorAssembler(inputCols=self.preparation.columns, outputCol="_x").transform(prepared))
        return scored.select("_row.*", vector_to_array("probability")[1].alias(p))


def fit(train: DataFrame, key: str, y: str, features: list[str], arm: Arm, seed: int = 0, preparation: Preparation | None = None, near: DataFrame | None = None) -> Fitted:
    """An arm on training rows: prepared (if it is not yet), oversampled if the arm says so (near: neighbours() of the
    prepared rows, if known), weighted by the ratio of what is left."""
    preparation = preparation or prepare(train, features)
    rows = preparation.apply(train.select(key, y, *features))
    if arm.ratio is not None:
        rows = smote(rows, key, y, preparation.columns, arm.ratio, seed=seed, near=near)
    weight = F.lit(1.0)
    if arm.weighted:
        n = rows.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
        weight = F.when(F.col(y) == 1, n[1] / max(1, n[0])).otherwise(1.0)
    rows = VectorAssembler(inputCols=preparation.columns, outputCol="_x").transform(rows.withColumn("_w", weight).withColumn("_y", F.col(y).cast("double")))
    common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w"}
    if arm.model == "logreg":
        estimator = LogisticRegression(regParam=arm.strength, standardization=False, maxIter=100, tol=1e-6, **common)
    elif arm.model == "gbt":
        estimator = GBTClassifier(maxIter=arm.trees, maxDepth=arm.depth, maxBins=63, stepSize=max(0.05, arm.strength), seed=seed, **common)
    else:
        raise ValueError(f"no such model: {arm.model}")
    return Fitted(preparation, estimator.fit(rows))


def parts(df: DataFrame, fold: Fold, day: str) -> tuple[DataFrame, DataFrame]:
    inside = lambda span: in_days(F.col(day), span[0], span[1] + 1)
    return df.where(inside(fold.train)), df.where(inside(fold.valid))


def out_of_fold(df: DataFrame, key: str, y: str, features: list[str], folds: list[Fold], arm: Arm, day: str = "tx_day", preparations: list[Preparation] | None = None) -> DataFrame:
    """df's rows in validation blocks, with fold and p by a model that saw none of them. Overlapping blocks are an error.

    preparations: of the training rows of each fold, if they are known.
    """
    spans = sorted(f.valid for f in folds)
    if any(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False)):
        raise ValueError("validation blocks overlap: rows would be scored twice")
    out = None
    for f, preparation in zip(folds, preparations or [None] * len(folds), strict=True):  # a model each: few, and each is a Spark job over its rows
        train, valid = parts(df, f, day)
        scored = fit(train, key, y, features, arm, preparation=preparation).score(valid).withColumn("fold", F.lit(f.fold))
        out = scored if out is None else out.unionByName(scored)
    return out


def cross_validate(df: DataFrame, key: str, y: str, features: list[str], folds: list[Fold], arm: Arm, day: str = "tx_day") -> DataFrame:
    """(arm, fold, n, prevalence, pr_auc, roc_auc) of each validation block."""
    scored = out_of_fold(df, key, y, features, folds, arm, day)
    m = ranking_metrics(scored, y, "p", ("fold",)).select("fold", "n", "prevalence", "pr_auc", "roc_auc")
    return m.select(F.lit(arm.name).alias("arm"), "*")


def search(df: DataFrame, key: str, y: str, features: list[str], folds: list[Fold], arms: list[Arm], day: str = "tx_day") -> DataFrame:
    """(arm, strength, trees, depth, mean and deviation of pr_auc over the folds), the best first.

    A fold's training rows are read, and their medians taken, once for all arms, and all arms are ranked in one pass.
    """
    each = []
    for f in folds:
        train, valid = (x.select(key, y, *features).persist() for x in parts(df, f, day))
        preparation, scored = prepare(train, features), None
        for i, arm in enumerate(arms):
            own = fit(train, key, y, features, arm, preparation=preparation).score(valid).select(F.lit(i).alias("_i"), y, "p")
            scored = own if scored is None else scored.unionByName(own)
        found = {m["_i"]: m["pr_auc"] for m in ranking_metrics(written(scored, "scores"), y, "p", ("_i",)).collect()}  # a row an arm
        each += [(i, arm.name, arm.strength, arm.trees, arm.depth, found.get(i)) for i, arm in enumerate(arms)]
        train.unpersist(), valid.unpersist()
    each = df.sparkSession.createDataFrame(each, "_i int, arm string, strength double, trees int, depth int, pr_auc double")
    out = each.groupBy("_i", "arm", "strength", "trees", "depth").agg(F.avg("pr_auc").alias("mean_pr_auc"), F.stddev_pop("pr_auc").alias("std_pr_auc")).drop("_i")
    return out.orderBy(F.desc("mean_pr_auc"), "arm", "strength", "trees", "depth")


def calibrator(oof: DataFrame, y: str, kind: str | None = None) -> tuple[str, float, float]:
    """(kind, a, b): the kind that the last fold likes best if none is given, then fitted anew on all folds."""
    kind = kind or calibrate.choose(oof, y, "p", "fold").first()["kind"]
    if kind == "shift" and (b := calibrate.fit_shift(oof, y, "p")) is not None:
        return kind, 1.0, b
    if kind == "platt" and (ab := calibrate.fit_platt(oof, y, "p")) is not None:
        return kind, *ab
    return "identity", 1.0, 0.0


def refit_and_score(train: DataFrame, valid: DataFrame, key: str, y: str, features: list[str], arm: Arm, found: tuple[str, float, float], preparation: Preparation | None = None) -> DataFrame:
    """valid with p_raw by a model of all training rows (preparation: theirs, if known), and p, calibrated."""
    scored = fit(train, key, y, features, arm, preparation=preparation).score(valid, "p_raw")
    return scored.withColumn("p", apply_calibrator(F.col("p_raw"), *found))


def df_of(few: DataFrame) -> DataFrame:
    """A table of a few rows, computed now."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def select_arm(train: DataFrame, valid: DataFrame, key: str, y: str, features: list[str], folds: list[Fold], arms: list[Arm], rules: Callable[[DataFrame], DataFrame], day: str = "tx_day") -> DataFrame:
    """By arm, the best on validation first: calibrator, ranking metrics, and what `rules` says of its scores (a row).

    Medians and deviations, of all training rows and of each fold's, are taken once for all arms; an arm's scores out of
    fold are a table before its calibrators are fitted, which read them many times.
    """
    out, whole = None, prepare(train, features)
    preparations = [prepare(parts(train, f, day)[0], features) for f in folds]
    for arm in arms:
        oof = written(out_of_fold(train, key, y, features, folds, arm, day, preparations).select(y, "p", "fold"), "scores")
        found = calibrator(oof, y)
        scored = refit_and_score(train, valid, key, y, features, arm, found, whole).persist()
        m = ranking_metrics(scored, y, "p").select("pr_auc", "roc_auc", "prevalence")
        row = m.crossJoin(rules(scored)).select(F.lit(arm.name).alias("arm"), F.lit(found[0]).alias("calibrator"), "*")  # one row each
        row = df_of(row)
        scored.unpersist()
        out = row if out is None else out.union(row)
    return out.orderBy(F.desc("pr_auc"), "arm")


def compare(train: DataFrame, others: dict[str, DataFrame], key: str, y: str, features: list[str], arms: dict[str, Arm], own: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, part, n, prevalence, pr_auc, roc_auc, lift) of each arm, fitted once, on each part.

    own: the features of an arm, where it does not take all. Medians are taken once for all arms, each row is scored once by
    each, and all scores are ranked in one pass.
    """
    train, scored, near = written(train.select(key, y, *features), "train"), None, None
    others = {part: written(rows.select(key, y, *features), "part") for part, rows in others.items()}
    whole = prepare(train, features)
    if sum(arm.ratio is not None for arm in arms.values()) > 1 and not own:
        near = written(neighbours(whole.apply(train), key, y, whole.columns), "near")
    for name, arm in arms.items():
        mine = (own or {}).get(name, features)
        fitted = fit(train, key, y, mine, arm, preparation=whole.of(mine), near=near)
        for part, rows in others.items():
            found = fitted.score(rows.select(key, y, *mine)).select(F.lit(name).alias("name"), F.lit(part).alias("part"), y, "p")
            scored = found if scored is None else scored.unionByName(found)
    m = ranking_metrics(written(scored, "scores"), y, "p", ("name", "part")).select("name", "part", "n", "prevalence", "pr_auc", "roc_auc", "lift")
    # A part without labelled rows has a row without figures.
    all_ = train.sparkSession.createDataFrame([(name, part) for name in arms for part in others], "name string, part string")
    return all_.join(m, ["name", "part"], "left")


def ratio_sweep(train: DataFrame, valid: DataFrame, key: str, y: str, features: list[str], ratios: list[float], model: str = "logreg") -> DataFrame:
    """compare() of one model over ratios of minority to majority."""
    return compare(train, {"valid": valid}, key, y, features, {f"{r:g}": Arm(model, ratio=r) for r in ratios})


def compact_models(train: DataFrame, valid: DataFrame, key: str, y: str, ranking: DataFrame, sizes: list[int], arm: Arm, fitted: Fitted | None = None) -> DataFrame:
    """(k, n, prevalence, pr_auc, roc_auc, d_pr_auc) of models of the k most important features, each fitted anew on the training
    rows, against the model of all of them. ranking: (feature, importance) of the training rows, a row a feature.

    fitted: the arm on the training rows with all of these features, if it is there; it is then not fitted again. Medians
    are taken once for all models.
    """
    ordered = [r["feature"] for r in ranking.orderBy(F.desc("importance"), "feature").select("feature").collect()]
    if fitted is not None and set(fitted.preparation.numbers) != set(ordered):
        raise ValueError("the fitted model has other features than the ranking")
    preparation = fitted.preparation if fitted else prepare(train, ordered)
    scored, out, whole = None, [], None
    valid = valid.select(key, y, *ordered)
    counts = sorted({len(ordered), *(k for k in sizes if k < len(ordered))}, reverse=True)
    for k in counts:
        own = fitted if fitted and k == len(ordered) else fit(train, key, y, ordered[:k], arm, preparation=preparation.of(ordered[:k]))
        own = own.score(valid).select(F.lit(k).alias("_k"), y, "p")
        scored = own if scored is None else scored.unionByName(own)
    found = {m["_k"]: m for m in ranking_metrics(written(scored, "scores"), y, "p", ("_k",)).collect()}  # a row a model
    for k in counts:
        n, prevalence, pr_auc, roc_auc = (found[k][c] if k in found else None for c in ("n", "prevalence", "pr_auc", "roc_auc"))
        whole = pr_auc if whole is None else whole
        out.append((k, n, prevalence, pr_auc, roc_auc, None if pr_auc is None else pr_auc - whole))
    return train.sparkSession.createDataFrame(out, "k int, n long, prevalence double, pr_auc double, roc_auc double, d_pr_auc double")


def leakage_probe(train: DataFrame, others: dict[str, DataFrame], key: str, y: str, features: list[str] | dict[str, list[str]], most: float = 0.99) -> DataFrame:
    """compare() of a small untuned model of trees, and plausible: whether a score is not too good to be true.

    features: those of the probe; or of several probes by name, which share all but their fits and say their name.
    """
    own = features if isinstance(features, dict) else {"probe": features}
    all_ = list(dict.fromkeys(c for mine in own.values() for c in mine))
    found = compare(train, others, key, y, all_, {name: Arm("gbt", strength=0.1) for name in own}, own)
    found = found.withColumn("plausible", F.coalesce(F.col("pr_auc") < most, F.lit(True)))
    return found if isinstance(features, dict) else found.drop("name")
