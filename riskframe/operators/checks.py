"""Check reports: one row a check, with how many things break it. Each is a small aggregate, those of one table in one
pass; a report is their union.

A report does not stop at what it finds: passed() raises for callers that want to.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions.rowwise import apply_calibrator, prior_correction
from riskframe.operators import audit
from riskframe.operators import validate as V
from riskframe.operators.split import Fold
from riskframe.sources.io import compare_frames, create_once, digest, exists

Check = tuple[str, DataFrame]  # a name, and one row with a count of what breaks it


def count_bad(df: DataFrame, bad: Column) -> DataFrame:
    """One row: the rows where `bad` holds. What is null counts as bad."""
    return df.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))


def known(spark: SparkSession, bad: int) -> DataFrame:
    """One row for what the driver knows already, such as names or folds."""
    return spark.range(1).select(F.lit(bad).cast("long").alias("bad"))


def together(df: DataFrame, bad: dict[str, Column] | None = None, **values: Column) -> DataFrame:
    """(check, bad) of several checks of a table in one pass: by name the rows where `bad` holds (null counts as bad;
    a row that a check leaves aside is a literal false to it), and aggregates by name, whose _ stand for spaces."""
    found = {name: F.count_if(F.coalesce(c, F.lit(True))) for name, c in (bad or {}).items()} | {name.replace("_", " "): c for name, c in values.items()}
    places = [f"_{i}" for i in range(len(found))]
    row = df.agg(*(c.cast("long").alias(place) for place, c in zip(places, found.values(), strict=True)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(name).alias("check"), F.col(place).alias("bad")) for place, name in zip(places, found, strict=True)))))


def report(checks: list[Check], *more: DataFrame) -> DataFrame:
    """(check, bad, result), in one Spark job: checks of their own, and tables (check, bad)."""
    rows = [one.select(F.lit(name).alias("check"), F.col(one.columns[0]).cast("long").alias("bad")) for name, one in checks]
    out = reduce(DataFrame.union, [*rows, *more])
    return out.withColumn("result", F.when(F.col("bad") == 0, "pass").otherwise("fail"))


def passed(found: DataFrame) -> None:
    failed = [r["check"] for r in found.where("bad > 0").orderBy("check").collect()]
    if failed:
        raise AssertionError(f"failed: {failed}")


def decreasing(df: DataFrame, x: str, f: Column, steps: int = 1_000) -> DataFrame:
    """One row: neighbouring steps of x, spread evenly over its range, between which f falls."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))

    def at(i: Column) -> Column:
        return F.col("lo") + (F.col("hi") - F.col("lo")) * i / steps

    both = grid.withColumn(x, at(F.col("i"))).withColumn("f", f).withColumn(x, at(F.col("i") + 1)).withColumn("g", f)
    return both.agg(F.count_if(F.coalesce(F.col("g") < F.col("f"), F.lit(True))).alias("bad"))


def out_of_days(df: DataFrame, day: str, low: int, high: int) -> DataFrame:
    return count_bad(df, ~F.col(day).between(low, high))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("bad"))


def validation_report(df: DataFrame, separation: DataFrame, probe: DataFrame, key: str, features: list[str], forbidden: list[str], order: list[str], gap: int, encoded: list[str], most_auc: float = 0.95) -> DataFrame:
    """C3: the structure of a split table, features that separate the classes alone, unseen categories' columns,
    missing shares that moved from the first split to the last, and a leakage probe's implausible scores."""
    structure = audit.structure(df, key, features, forbidden, order, gap)
    rows = structure.select("check", F.col("seen").alias("bad"))
    first, last = (df.where(F.col("split") == s) for s in (order[0], order[-1]))
    more: list[Check] = [
        ("separation", count_bad(separation, F.col("separation") > most_auc)),
        ("unseen", counted(V.unseen_share(df.where(F.col("split") != order[0]), encoded).where("unseen_share > 0.5"))),
        ("missing_drift", counted(V.missing_drift(first, last, features))),
        ("probe", count_bad(probe, ~F.col("plausible"))),
    ]
    return rows.withColumn("result", F.when(F.col("bad") == 0, "pass").otherwise("fail")).union(report(more))


def protocol_report(train: DataFrame, valid: DataFrame, oof: DataFrame, folds: list[Fold], key: str, y: str, day: str, purge: int, features: tuple[list[str], list[str]], forbidden: list[str], prevalence: float, calibrator: tuple[str, float, float], priors: tuple[float, float]) -> DataFrame:
    """C4: contracts, order and gap of the parts, folds, out-of-fold rows, priors (of the resampled rows, and the lower
    true one, whose correction is seen on the run's own scores) and calibrators of a modelling run."""
    spark = train.sparkSession
    gaps = [f.valid[0] - f.train[1] - 1 for f in folds]
    spans = sorted(f.valid for f in folds)
    gap = train.agg(F.max(day).alias("a")).join(F.broadcast(valid.agg(F.min(day).alias("b"))))  # a row each
    corrected = prior_correction(F.col("p"), *priors)
    inner = (F.col("p") > 0) & (F.col("p") < 1)
    folded = F.coalesce(sum(((F.col("fold") == f.fold) & F.col(day).between(*f.valid)).cast("int") for f in folds), F.lit(0))
    return report(
        [
            ("same contract", known(spark, len(V.contract_diff(*features)))),
            ("key and label absent", known(spark, len(set(features[0]) & {key, y, day, *forbidden}))),
            ("parts in order", count_bad(gap, F.col("b") - F.col("a") <= purge)),
            ("parts disjoint", counted(V.leaked_keys(train, valid, key))),
            ("folds purged", known(spark, sum(g != purge for g in gaps))),
            ("folds in order", known(spark, sum(f.train[1] >= f.valid[0] for f in folds))),
            ("validation blocks disjoint", known(spark, sum(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False)))),
            ("out-of-fold rows once", repeated(oof, key)),
            ("out-of-fold rows of training only", counted(oof.select(key).join(train.select(key), key, "left_anti"))),
            ("validation prevalence untouched", count_bad(valid.agg(F.avg(y).alias("r")), F.abs(F.col("r") - prevalence) >= 5e-5)),
            ("prior correction keeps order", decreasing(oof, "p", corrected)),
            ("calibrator monotone", decreasing(oof, "p", apply_calibrator(F.col("p"), *calibrator))),
        ],
        together(oof, {"out-of-fold rows in their block": folded != 1, "prior correction lowers": F.when(inner, corrected >= F.col("p")).otherwise(False)}),
    )


def explanation_report(contributions: DataFrame, margins: DataFrame, id: str, groups: dict[str, str], family: Column, selected: DataFrame, base: float, calibrator: tuple[str, float, float], limit: float = 1e-4) -> DataFrame:
    """C5: contributions (id, feature, contribution) against margins (id, margin): additivity by row and in the mean,
    groups and families that cover each feature once, family sums, selection rows kept out, a monotone calibrator."""
    spark = contributions.sparkSession
    totals = contributions.groupBy(id).agg(F.sum("contribution").alias("total"))
    both = totals.join(margins, id, "full")
    gap = F.abs(F.col("total") + base - F.col("margin"))
    names = contributions.select("feature").distinct()
    grouped = spark.createDataFrame(sorted(groups.items()), "feature string, grp string")
    parts = contributions.groupBy(id, family.alias("_f")).agg(F.sum("contribution").alias("part")).groupBy(id).agg(F.sum("part").alias("parts"))
    means = both.agg((F.avg("total") + base - F.avg("margin")).alias("gap"))
    return report(
        [
            ("additive on every row", count_bad(both, gap >= limit)),
            ("mean of sums is the mean margin", count_bad(means, F.abs("gap") >= limit)),
            ("every feature in a group", counted(names.join(grouped, "feature", "left_anti"))),
            ("no group of unknown features", counted(grouped.join(names, "feature", "left_anti"))),
            ("every feature in one family", count_bad(names, family.isNull())),
            ("family sums make the total", count_bad(totals.join(parts, id, "full"), F.abs(F.col("total") - F.col("parts")) >= limit)),
            ("selection rows kept out", counted(V.leaked_keys(selected, margins, id))),
            ("one margin a row", repeated(margins, id)),
            ("contributions once a row and feature", counted(contributions.groupBy(id, "feature").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))),
            ("calibrator monotone", decreasing(margins.select(F.col("margin").alias("z")), "z", 1 / (1 + F.exp(-(calibrator[1] * F.col("z") + calibrator[2]))))),
        ]
    )


def serving_report(history: DataFrame, served: DataFrame, batch: DataFrame, log: DataFrame, key: str, day: str, sealed_day: int, features: list[str], threshold: float, calibrator: tuple[str, float, float]) -> DataFrame:
    """C6: the history store sealed and without repeats, served features equal to batch ones, decisions equal to
    p >= threshold and to those of the batch, scores in [0, 1], a monotone calibrator, nulls where batch has them."""
    cells = compare_frames(batch, served, key, features)
    nulls = served.select(key, *(F.col(c).isNull().alias(c) for c in features)).unpivot([key], features, "feature", "a")
    other = batch.select(key, *(F.col(c).isNull().alias(c) for c in features)).unpivot([key], features, "feature", "b")
    wanted = F.when(F.col("p") >= threshold, "review").otherwise("accept")
    flips = log.join(batch.select(key, F.col("p").alias("_p")), key)
    return report(
        [
            ("store sealed", count_bad(history, F.col(day) > sealed_day)),
            ("store without repeats", repeated(history, key)),
            ("served features equal batch", cells.agg(F.sum("differing").alias("bad"))),
            ("nulls equal batch", count_bad(nulls.join(other, [key, "feature"]), F.col("a") != F.col("b"))),
            ("no decision flips", count_bad(flips, (F.col("_p") >= threshold) != (F.col("p") >= threshold))),
            ("one decision a key", repeated(log, key)),
            ("calibrator monotone", decreasing(log, "p", apply_calibrator(F.col("p"), *calibrator))),
        ],
        together(log, {"decisions follow the threshold": F.col("decision") != wanted, "scores are probabilities": ~F.col("p").between(0, 1)}),
    )


def monitoring_report(log: DataFrame, sealed: DataFrame, history_days: DataFrame, reference: DataFrame, self_psi: DataFrame, verdicts: DataFrame, key: str, day: str, window: tuple[int, int], contract: list[str], n: int, most_missing: float, threshold: Column, digests: tuple[tuple[int, str], tuple[int, str]]) -> DataFrame:
    """C7: sealed keys out of the log, its days inside the window, sources as frozen, one threshold, a well-formed
    monitored set, references that reproduce themselves, no repeats, and a baseline that calls for no retraining."""
    names = reference.select("feature")
    inside = reference.sparkSession.createDataFrame([(c,) for c in contract], "feature string")
    return report(
        [
            ("sealed keys out of the log", counted(V.leaked_keys(log, sealed, key))),
            ("days inside the window", count_bad(log.join(history_days, key, "left"), ~F.col(day).between(*window))),
            ("sources unchanged", known(log.sparkSession, int(digests[0] != digests[1]))),
            ("one threshold", log.agg((F.count_distinct(threshold) - 1).alias("bad"))),
            ("monitored features in the contract", counted(names.join(inside, "feature", "left_anti"))),
            ("references reproduce themselves", count_bad(self_psi, F.col("psi") >= 1e-9)),
            ("one decision a key", repeated(log, key)),
            ("baseline calls for no retraining", count_bad(verdicts, F.col("decision") == "retrain")),
        ],
        together(reference, {"monitored features mostly present": F.col("missing_share") > most_missing}, as_many_monitored_features_as_agreed=F.abs(F.count(F.lit(1)) - n)),
    )


def evaluation_report(log: DataFrame, labels: DataFrame, drift: DataFrame, key: str, day: str, run: str, expected_rows: int, earlier: tuple[str, int], days: tuple[int, int], thresholds: list[float], frozen: dict[str, tuple[object, object]], openings: int, selection: DataFrame, resampled: DataFrame) -> DataFrame:
    """C8: a final evaluation on sealed rows, from its decision log (key, day, p, threshold, decision, run_label,
    scored_at), its labels, and its daily drift (day, variant, psi).

    The rows were opened once, each was scored once, all are labelled, in the order of days, with none left out; rows
    of earlier runs (a prefix of labels and their number) stayed as they were; one threshold, that of all `thresholds`;
    frozen things (name to what they were and are: a specification, a reference, digests of sources) did not change;
    drift stays inside the days and has both variants; no key that chose a model, and none that was made by resampling,
    is among the scored ones.
    """
    spark, own = log.sparkSession, log.where(F.col("run_label") == run)
    low, high = days
    first = own.groupBy(day).agg(F.min("scored_at").alias("first"))
    backwards = first.withColumn("before", F.lag("first").over(Window.orderBy(day))).where("first < before")  # a row a day
    missing = spark.range(low, high + 1).select(F.col("id").cast("int").alias(day)).join(first, day, "left_anti")
    variants = drift.groupBy(day).agg(F.count_distinct("variant").alias("n"))
    rows = [
        ("opened once", known(spark, abs(openings - 1))),
        ("every row labelled", counted(own.join(labels.where(F.col(labels.columns[1]).isNotNull()), key, "left_anti"))),
        ("one decision a key", repeated(own, key)),
        ("days scored in order", counted(backwards)),
        ("every day present", counted(missing)),
        *((f"{name} unchanged", known(spark, int(was != now))) for name, (was, now) in frozen.items()),
        ("drift inside the days", count_bad(drift, ~F.col(day).between(low, high))),
        ("both variants of drift", count_bad(variants, F.col("n") != 2)),
        ("no selection on scored rows", counted(V.leaked_keys(selection, own, key))),
        ("no scored row was resampled", counted(V.leaked_keys(resampled, own, key))),
    ]
    mine = F.col("run_label").eqNullSafe(F.lit(run))
    wanted = F.when(F.col("p") >= F.col("threshold"), "review").otherwise("accept")
    each = {
        "no run pending": F.col("run_label").eqNullSafe(F.lit("pending")),
        "no day outside": mine & ~F.col(day).between(low, high),
        "decisions follow the threshold": mine & ~wanted.eqNullSafe(F.col("decision")),
    }
    totals = {
        "as_many_rows_as_expected": F.abs(F.count_if(mine) - expected_rows),
        "earlier_rows_untouched": F.abs(F.count_if(F.col("run_label").startswith(earlier[0])) - earlier[1]),
        "one_threshold_everywhere": F.count_if(mine & ~F.col("threshold").eqNullSafe(F.lit(thresholds[0]))) + int(len(set(thresholds)) > 1),
    }
    return report(rows, together(log, each, **totals))


def fingerprint(df: DataFrame, y: str, day: str, features: list[str]) -> dict[str, object]:
    """Rows, positives, days and the feature contract of a training table: what a cached result depends on."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("long")), F.min(day), F.max(day)).first()
    return {"rows": r[0], "positives": r[1], "first_day": r[2], "last_day": r[3], "features": list(features)}


def stale_reasons(cached: dict[str, object], current: dict[str, object]) -> list[str]:
    """Which parts of a cached fingerprint no longer hold; empty if the cache may be used."""
    return [f"{k}: {cached.get(k)} is now {current.get(k)}" for k in sorted({*cached, *current}) if cached.get(k) != current.get(k)]


class Ledger:
    """A read-once ledger of sealed tables: a file of JSON for each opening, with a digest of the content.

    The file is created or the opening fails: of two at once, one is refused.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> list[dict]:
        if not exists(self.spark, self.path):
            return []
        lines = self.spark.read.text(self.path).where("value <> ''").collect()  # one an opening: few
        return sorted((json.loads(r[0]) for r in lines), key=lambda e: (e["opened"], e["name"]))

    def open(self, name: str, df: DataFrame, opened: str, purpose: str) -> DataFrame:
        """df, its opening recorded. A second opening, or a content that changed since the first, is refused."""
        rows, content = digest(df)
        entry = json.dumps({"name": name, "opened": opened, "purpose": purpose, "rows": rows, "digest": content})
        if create_once(self.spark, f"{self.path}/{hashlib.sha256(name.encode()).hexdigest()}.json", entry):
            return df
        for e in self.entries():
            if e["name"] == name:
                changed = (e["rows"], e["digest"]) != (rows, content)
                raise PermissionError(f"{name} was opened at {e['opened']} for {e['purpose']}" + (", and has changed since" if changed else ""))
        raise PermissionError(f"{name} is being opened")

    def problems(self, tables: dict[str, DataFrame]) -> list[str]:
        """Sealed tables opened more than once or never, and those whose content is not what was opened."""
        seen = self.entries()
        out = []
        for name, df in tables.items():
            own = [e for e in seen if e["name"] == name]
            if len(own) != 1:
                out.append(f"{name} was opened {len(own)} times")
            elif (own[0]["rows"], own[0]["digest"]) != digest(df):
                out.append(f"{name} has changed since it was opened")
        return out
