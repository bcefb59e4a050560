"""Row-wise feature functions: Column in, Column out, nothing but built-ins (all stay in code generation)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
# Ordered name rules of the feature families; the first that matches holds.
FAMILIES = (("frequency", r"_freq$"), ("missingness", r"^(miss|has)_|_missing$"), ("velocity", r"^(card|acct)_"), ("time", r"^(tx|hour|weekday)_"), ("amount", r"^amt_"), ("anchor", r"_anchor$"), ("anonymous", r"^v[0-9]+$"))


def time_parts(df: DataFrame, t: str = "t") -> DataFrame:
    """Day, hour, weekday, their cyclic forms and a night flag (0 <= hour < 6) of integer seconds."""
    s = F.col(t)
    df = df.withColumns({"tx_day": F.floor(s / DAY).cast("int"), "tx_hour": F.pmod(F.floor(s / 3600), F.lit(24)).cast("int")})
    df = df.withColumn("tx_weekday", F.pmod("tx_day", F.lit(7)).cast("int"))
    cyclic = {f"{n}_{f.__name__}": f(2 * F.pi() * F.col(f"tx_{n}") / period) for n, period in (("hour", 24), ("weekday", 7)) for f in (F.sin, F.cos)}
    return df.withColumns(cyclic | {"tx_night": F.col("tx_hour").between(0, 5).cast("int")})


def anchors(df: DataFrame, counters: list[str], day: str = "tx_day") -> DataFrame:
    """Day counters as the day they count from; null where the counter is null."""
    return df.withColumns({f"{c}_anchor": F.col(day) - F.col(c) for c in counters})


def decimal_digits(cents: Column, places: int = 6) -> Column:
    """Significant decimals of a fraction in [0, 1) without trailing zeros; null stays null."""
    return F.length(F.rtrim(F.lpad(F.rint(cents * 10**places).cast("bigint").cast("string"), places, "0"), F.lit("0")))


def amount_features(df: DataFrame, amount: str = "amount") -> DataFrame:
    """log1p, fraction rounded half-even to 6 places, its significant digits, and whether it is whole."""
    a = F.col(amount)
    df = df.withColumns({"amt_log": F.log1p(a), "amt_cents": F.bround(a - F.floor(a), 6)})
    return df.withColumns({"amt_digits": decimal_digits(F.col("amt_cents")), "amt_round": (F.col("amt_cents") == 0).cast("int")})


def domain_provider(domain: Column) -> Column:
    return F.substring_index(F.lower(domain), ".", 1)


def domain_suffix(domain: Column) -> Column:
    """What follows the first dot; null where there is none."""
    low = F.lower(domain)
    return F.nullif(F.when(F.instr(low, ".") > 0, F.regexp_replace(low, r"^[^.]*\.", "")).otherwise(F.lit("")), F.lit(""))


def match_flag(a: Column, b: Column) -> Column:
    """1 or 0 where both are present, else null."""
    return (a == b).cast("float")


def map_flag(c: Column) -> Column:
    """T to 1, F to 0, all else to null."""
    return F.when(c == "T", F.lit(1)).when(c == "F", F.lit(0))


def as_key(c: Column) -> Column:
    """A stable text of a numeric id: its whole number, NA for null."""
    return F.coalesce(c.cast("bigint").cast("string"), F.lit("NA"))


def entity_keys(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Nested entity keys: each level's columns as keys, joined by underscores."""
    return df.withColumns({name: F.concat_ws("_", *(as_key(F.col(c)) for c in cols)) for name, cols in levels.items()})


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where it would not be finite."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def missing_count(cols: list[str]) -> Column:
    return reduce(add, [F.col(c).isNull().cast("int") for c in cols], F.lit(0))


def missingness_features(df: DataFrame, families: dict[str, list[str]], linked: list[str]) -> DataFrame:
    """has_identity (any linked column present), missing counts by family, and a flag for each linked column."""
    out = {"has_identity": F.coalesce(*(F.col(c).cast("string") for c in linked)).isNotNull().cast("int")}
    out |= {f"miss_{name}": missing_count(cols) for name, cols in families.items()}
    return df.withColumns(out | {f"{c}_missing": F.col(c).isNull().cast("int") for c in linked})


def feature_family(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, pattern in reversed(FAMILIES):
        out = F.when(name.rlike(pattern), F.lit(family)).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def in_days(day: Column, low: int, high: int) -> Column:
    return (day >= low) & (day < high)


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))


def odds_correction(p: Column, factor: float) -> Column:
    """The probability whose odds are those of p divided by factor (> 0)."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    return p / (p + factor * (1 - p))


def prior_correction(p: Column, resampled: float, true: float) -> Column:
    return odds_correction(p, (resampled / (1 - resampled)) / (true / (1 - true)))


def shift_prior(p: Column, factor: float) -> Column:
    """The probability whose odds are those of p times factor."""
    return odds_correction(p, 1 / factor)


def apply_calibrator(p: Column, kind: str, a: float = 1.0, b: float = 0.0) -> Column:
    return p if kind == "identity" else sigmoid(a * logit(p) + b)


def decide(p: Column, threshold: float) -> Column:
    return F.when(p >= threshold, "review").otherwise("accept")


def per_row_rule(p: Column, amount: Column, review_cost: float) -> Column:
    """Review where p > cost / amount, never for amounts of zero or less."""
    return ((amount > 0) & (p > F.try_divide(F.lit(float(review_cost)), amount))).cast("int")


def block_of(feature: Column) -> Column:
    return F.when(feature.startswith("V-group"), "anonymised").otherwise("named")


def stateless(df: DataFrame, t: str, counters: list[str], amount: str, domains: tuple[str, str] | None = None, flags: tuple[str, ...] = ()) -> DataFrame:
    """The row-wise features in the order that they depend on one another: time, anchors, amount, domains, flags."""
    df = amount_features(anchors(time_parts(df, t), counters), amount)
    if domains:
        a, b = domains
        df = df.withColumns({f"{c}_{n}": f(F.col(c)) for c in domains for n, f in (("provider", domain_provider), ("suffix", domain_suffix))})
        df = df.withColumn("domain_match", match_flag(F.lower(a), F.lower(b)))
    return df.withColumns({c: map_flag(F.col(c)) for c in flags})


def render_feature(feature: Column, groups: dict[str, str]) -> Column:
    """The group of an anonymous feature ("V-group 3" for group g3) in place of its name; other names as they are."""
    if not groups:
        return feature
    named = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair))
    return F.coalesce(F.concat(F.lit("V-group "), F.substr(named[feature], F.lit(2))), feature)


def explode_reasons(df: DataFrame, id: str, reasons: str) -> DataFrame:
    """(id, rank, feature, contribution) of an array of reason structs; rows without reasons have none."""
    return df.select(id, F.posexplode(reasons).alias("_at", "_r")).select(id, (F.col("_at") + 1).alias("rank"), "_r.feature", "_r.contribution")


def perturb(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * factor)
