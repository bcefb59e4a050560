"""Strictly-past windows by entity: the current row and its exact timestamp ties never count.

past_window uses sliding frames, which aggregate their rows anew for each row and hold a key in one task: for keys of
few rows. segmented gives the same numbers in time that grows with the rows alone, with a key dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.rowwise import safe_ratio

HOUR, DAY = 3_600, 86_400


def past(key: str, t: str, seconds: int | None) -> Window:
    """[t - seconds, t), or everything before t."""
    return Window.partitionBy(key).orderBy(t).rangeBetween(Window.unboundedPreceding if seconds is None else -seconds, -1)


def past_aggregates(key: str, t: str, value: str, seconds: int | None, name: str) -> dict[str, Column]:
    """Count of rows; sum, mean and sample deviation of the values that are not null (null where there are none)."""
    w = past(key, t, seconds)
    return {f"{name}_cnt": F.count(F.lit(1)).over(w), f"{name}_sum": F.sum(value).over(w), f"{name}_mean": F.avg(value).over(w), f"{name}_std": F.stddev_samp(value).over(w)}


def past_window(df: DataFrame, key: str, t: str, value: str, windows: dict[str, int | None], prefix: str) -> DataFrame:
    out: dict[str, Column] = {}
    for label, seconds in windows.items():
        out |= past_aggregates(key, t, value, seconds, f"{prefix}_{label}")
    return df.withColumns(out)


def past_window_by_prefix(df: DataFrame, key: str, t: str, value: str, seconds: int, name: str) -> DataFrame:
    """The same as one window of past_window, whatever the rows of a key: see segmented."""
    return segmented(df, key, t, value, {"w": seconds}).select(*df.columns, *(F.col(f"w_{c}").alias(f"{name}_{c}") for c in STATS))


def secs_since_prev(key: str, t: str) -> Column:
    """Seconds since the last strictly earlier row of the key."""
    return F.col(t) - F.max(t).over(past(key, t, None))


def first_flag(cols: list[str], t: str, id: str) -> Column:
    """1 on the earliest row of each combination, ties by id."""
    return (F.row_number().over(Window.partitionBy(*cols).orderBy(t, id)) == 1).cast("int")


def past_distinct(df: DataFrame, key: str, t: str, other: str, id: str, name: str) -> DataFrame:
    """Distinct values of other (null is one) before t; 0 without history."""
    flagged = df.withColumn("_first", first_flag([key, other], t, id))
    return flagged.withColumn(name, F.coalesce(F.sum("_first").over(past(key, t, None)), F.lit(0))).drop("_first")


#: Seconds of a time bucket of segmented windows, and buckets of a span.
BUCKET, SPAN = HOUR, 168
STATS = ("cnt", "sum", "mean", "std")


def moments(x: Column, rows: Column, deviations: bool, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """n rows, and of the values m, their sum, and if asked mean and sum of squared deviations, as a struct without nulls."""
    values = F.when(rows, x)
    some = lambda c: F.coalesce(over(c), F.lit(0.0))
    m = over(F.count(values))
    parts = [over(F.count_if(rows)).alias("n"), m.alias("m"), some(F.sum(values)).alias("s")]
    if deviations:
        parts += [some(F.avg(values)).alias("mean"), (some(F.var_pop(values)) * m).alias("q")]
    return F.struct(*parts)


def both(a: Column, b: Column) -> Column:
    """The moments of two parts together: deviations are added up about each part's own mean, nothing is subtracted."""
    m = a["m"] + b["m"]
    share = F.when(m > 0, b["m"] / m).otherwise(0.0)
    d = b["mean"] - a["mean"]
    mean = F.when(a["m"] == 0, b["mean"]).otherwise(a["mean"] + d * share)
    q = F.when(a["m"] == 0, b["q"]).otherwise(a["q"] + b["q"] + d * d * share * a["m"])
    return F.struct((a["n"] + b["n"]).alias("n"), m.alias("m"), (a["s"] + b["s"]).alias("s"), mean.alias("mean"), q.alias("q"))


def zero() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("s"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("q"))


def merged(parts: Column) -> Column:
    return F.aggregate(parts, zero(), both)


def segmented(df: DataFrame, key: str, t: str, value: str, windows: dict[str, int | None], *, distinct: dict[str, str] | None = None, real: Column | None = None, source: DataFrame | None = None, plain: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """df with <label>_cnt, _sum, _mean and _std of each window [t - seconds, t) (None: all before t), `gap`, the seconds
    since the last earlier row, and <name>_distinct, how many values of a column (null is one) came before.

    A key's time is cut into buckets, and rows are dealt by key and bucket, so that a hot key is spread over as many
    tasks as it has buckets. A window is the end of one bucket, whole buckets, and the beginning of the row's own: a row
    stands in its own bucket and, moved on by each window's length, in the one where it leaves, so that one shuffle
    brings both ends to the rows that ask. Whole buckets are merged from totals, a row for each key and bucket. Sums and
    moments only ever add what is inside the window. Windows are multiples of `bucket` seconds.

    NaN is a missing value, a null key is a key of its own. real: the rows that count (all by default); the others only
    ask. source: df, where it is cheaper to read again (the totals come from it). plain: windows of which only _cnt and
    _sum are wanted, which takes less.
    """
    deep = {label for label in windows if label not in plain}
    limited = {label: seconds for label, seconds in windows.items() if seconds is not None}
    if bad := [s for s in limited.values() if s <= 0 or s % bucket]:
        raise ValueError(f"windows of {bad} seconds are no multiples of {bucket}")
    distinct = distinct or {}
    counts = F.lit(True) if real is None else F.coalesce(real, F.lit(False))
    x = F.col(value).cast("double")

    def base(d: DataFrame) -> DataFrame:
        return d.select(F.struct(F.col(key)).alias("_key"), F.col(t).cast("long").alias("_t"), F.when(~F.isnan(x), x).alias("_v"), counts.alias("_c"), F.struct(*(F.col(c) for c in d.columns)).alias("_row"))

    rows, again = base(df), base(df if source is None else source)
    mark = lambda k, e, r: F.struct(F.lit(k).alias("_k"), e.alias("_e"), r.alias("_row"))
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    own = F.array(mark(0, F.col("_t"), F.col("_row")))
    gone = F.array(*(mark(i, F.col("_t") + s, none) for i, s in enumerate(limited.values(), 1)))
    events = rows.select("_key", "_v", "_c", F.inline(F.when(F.col("_c"), F.concat(own, gone)).otherwise(own) if limited else own))
    firsts = None
    for j, other in enumerate(distinct.values(), 1):
        first = again.where("_c").groupBy("_key", F.col(f"_row.{other}").alias("_o")).agg(F.min("_t").alias("_t"))
        first = first.select("_key", F.lit(None).cast("double").alias("_v"), F.lit(False).alias("_c"), F.lit(-j).alias("_k"), F.col("_t").alias("_e"))
        firsts = first if firsts is None else firsts.union(first)
        events = events.union(first.withColumn("_row", none))
    of = lambda e: F.expr(f"({e} - pmod({e}, {bucket})) div {bucket}")
    asked = F.col("_k") == 0
    before = Window.partitionBy("_key", "_b").orderBy("_e").rangeBetween(Window.unboundedPreceding, -1)
    since = Window.partitionBy("_key", "_b").orderBy(F.desc("_e")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends: dict[str, Column] = {"_head": moments(F.col("_v"), asked & F.col("_c"), bool(deep), lambda c: c.over(before)), "_last": F.max(F.when(asked & F.col("_c"), F.col("_e"))).over(before)}
    ends |= {f"_d{j}": F.count_if(F.col("_k") == -j).over(before) for j in range(1, len(distinct) + 1)}
    ends |= {f"_tail{i}": moments(F.col("_v"), F.col("_k") == i, label in deep, lambda c: c.over(since)) for i, label in enumerate(limited, 1)}
    found = events.withColumn("_b", of("_e")).withColumns(ends).where(asked).select("_key", "_b", "_row", F.col("_e"), *ends)

    totals = again.select("_key", "_v", "_c", F.lit(0).alias("_k"), F.col("_t").alias("_e"))
    totals = (totals if firsts is None else totals.union(firsts)).withColumn("_b", of("_e"))
    each = {"_m": moments(F.col("_v"), F.col("_c"), bool(deep)), "_last_t": F.max(F.when(F.col("_c"), F.col("_e")))} | {f"_n{j}": F.count_if(F.col("_k") == -j) for j in range(1, len(distinct) + 1)}
    totals = totals.groupBy("_key", "_b").agg(*(c.alias(n) for n, c in each.items()))
    up = Window.partitionBy("_key").orderBy("_b")
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = {"_last_whole": F.max("_last_t").over(earlier)} | {f"_w{j}": F.coalesce(F.sum(f"_n{j}").over(earlier), F.lit(0)) for j in range(1, len(distinct) + 1)}
    sums = lambda over: F.struct(*(F.coalesce(F.sum(F.col("_m")[c]).over(over), F.lit(0)).alias(c) for c in "nms"))
    for i, (label, seconds) in enumerate(limited.items(), 1):
        if seconds > bucket:
            inside = up.rangeBetween(1 - seconds // bucket, -1)
            whole[f"_whole{i}"] = F.collect_list("_m").over(inside) if label in deep else sums(inside)
    unlimited = len(limited) < len(windows)
    deep_all = any(label in deep for label, seconds in windows.items() if seconds is None)
    if unlimited and not deep_all:
        whole["_all"] = sums(earlier)
    if deep_all:
        # All before: the buckets of the same span before this one, and the spans before it.
        totals = totals.withColumn("_span", F.expr(f"(_b - pmod(_b, {SPAN})) div {SPAN}"))
        spans = totals.groupBy("_key", "_span").agg(merged(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_m"))), lambda z: z["_m"])).alias("_s"))
        spans = spans.withColumn("_spans", F.collect_list("_s").over(Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)))
        whole["_inner"] = F.collect_list("_m").over(Window.partitionBy("_key", "_span").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumns(whole)
    if deep_all:
        totals = totals.join(spans.select("_key", "_span", "_spans"), ["_key", "_span"]).withColumn("_all", merged(F.concat("_spans", "_inner")))
    totals = totals.withColumns({f"_whole{i}": merged(F.col(f"_whole{i}")) for i, label in enumerate(limited, 1) if label in deep and f"_whole{i}" in whole})
    kept = [*(c for c in whole if c.startswith("_whole")), *(["_all"] if unlimited else []), "_last_whole", *(f"_w{j}" for j in range(1, len(distinct) + 1))]
    found = found.join(totals.select("_key", "_b", *kept), ["_key", "_b"], "left")
    pieces = {label: ["_all"] if seconds is None else [f"_tail{i}", f"_whole{i}"] if seconds > bucket else [f"_tail{i}"] for i, (label, seconds) in [(list(limited).index(x[0]) + 1 if x[0] in limited else 0, x) for x in windows.items()]}
    first = {f"_x_{label}": both(F.col(own[0]), F.col(own[1] if len(own) > 1 else "_head")) for label, own in pieces.items() if label in deep}
    second = {f"_x_{label}": both(F.col(f"_x_{label}"), F.col("_head")) for label, own in pieces.items() if label in deep and len(own) > 1}
    found = found.withColumns(first).withColumns(second) if first else found
    out: dict[str, Column] = {}
    for label, own in pieces.items():
        if label in deep:
            c = F.col(f"_x_{label}")
            out |= {f"{label}_cnt": c["n"], f"{label}_sum": F.when(c["m"] > 0, c["s"]), f"{label}_mean": F.when(c["m"] > 0, c["mean"]), f"{label}_std": F.when(c["m"] > 1, F.sqrt(c["q"] / (c["m"] - 1)))}
        else:
            n, m, x = (sum((F.col(p)[c] for p in own), F.col("_head")[c]) for c in "nms")
            out |= {f"{label}_cnt": n, f"{label}_sum": F.when(m > 0, x)}
    out["gap"] = F.col("_e") - F.coalesce("_last", "_last_whole")
    out |= {f"{name}_distinct": F.col(f"_d{j}") + F.col(f"_w{j}") for j, name in enumerate(distinct, 1)}
    return found.select("_row.*", *(c.alias(n) for n, c in out.items()))


#: Rows of a key up to which sliding frames, which add up their rows anew for each row, are cheaper than segments.
FEW = 1_000


def slid(df: DataFrame, key: str, t: str, value: str, windows: dict[str, int | None], distinct: dict[str, str], plain: tuple[str, ...]) -> DataFrame:
    """What segmented gives, by sliding frames over one sort of each key's rows; a null in t is not expected."""
    x = F.col(value).cast("double")
    d = df.withColumns({"_at": F.col(t).cast("long"), "_v": F.when(~F.isnan(x), x)})
    d = d.withColumns({f"_f{j}": (F.row_number().over(Window.partitionBy(key, other).orderBy("_at")) == 1).cast("int") for j, other in enumerate(distinct.values())}) if distinct else d
    out: dict[str, Column] = {}
    for label, seconds in windows.items():
        found = past_aggregates(key, "_at", "_v", seconds, label)
        out |= {n: c for n, c in found.items() if label not in plain or n in (f"{label}_cnt", f"{label}_sum")}
    out["gap"] = secs_since_prev(key, "_at")
    # The first row of a value counts from then on; of several at one time it does not matter which is the first.
    out |= {f"{name}_distinct": F.coalesce(F.sum(f"_f{j}").over(past(key, "_at", None)), F.lit(0)) for j, name in enumerate(distinct)}
    return d.select(*df.columns, *(c.alias(n) for n, c in out.items()))


def by_rows_of_key(df: DataFrame, key: str, t: str, value: str, windows: dict[str, int | None], *, distinct: dict[str, str] | None = None, source: DataFrame | None = None, plain: tuple[str, ...] = ()) -> DataFrame:
    """segmented for the keys of more than FEW rows (and those with a null time), slid for all others, with the same result.

    Segments shuffle a row once for each window and sort it twice, which only hot keys are worth.
    """
    source = df if source is None else source
    own = F.struct(F.col(key))
    hot = source.groupBy(own.alias("_hot")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(t).isNull()).alias("_null")).where((F.col("_n") > FEW) | (F.col("_null") > 0)).select("_hot")
    if hot.isEmpty():
        return slid(df, key, t, value, windows, distinct or {}, plain)
    # At most a FEWth of the rows: broadcast, so that a hot key stays dealt.
    part = lambda d, how: d.join(F.broadcast(hot), own == F.col("_hot"), how)
    many = segmented(part(df, "left_semi"), key, t, value, windows, distinct=distinct, source=part(source, "left_semi"), plain=plain)
    return slid(part(df, "left_anti"), key, t, value, windows, distinct or {}, plain).unionByName(many)


def entity_aggregates(df: DataFrame, keys: dict[str, str], t: str, amount: str, others: dict[str, str]) -> DataFrame:
    """Velocity features of each entity key: counts and sums in windows, history means and deviations, ratio and
    z-score of the amount, gaps, and distinct counts of `others` for the last key."""
    windows = {"1h": HOUR, "24h": DAY, "7d": 7 * DAY, "hist": None}
    last, given = list(keys)[-1], df
    a = F.when(~F.isnan(F.col(amount).cast("double")), F.col(amount))
    for prefix, key in keys.items():
        found = by_rows_of_key(df, key, t, amount, windows, distinct=others if prefix == last else {}, source=given, plain=("1h", "24h", "7d"))
        names = {f"{label}_{c}": f"{prefix}_{'cnt' if c == 'cnt' else 'amt_sum'}_{label}" for label in ("1h", "24h", "7d") for c in ("cnt", "sum")}
        names |= {"hist_mean": f"{prefix}_amt_mean_hist", "hist_std": f"{prefix}_amt_std_hist", "gap": f"{prefix}_gap"}
        names |= {f"{name}_distinct": f"{prefix}_{name}_distinct" for name in others if prefix == last}
        more = {f"{prefix}_amt_ratio": safe_ratio(a, F.col("hist_mean")), f"{prefix}_amt_z": safe_ratio(a - F.col("hist_mean"), F.col("hist_std"))}
        df = found.select(*df.columns, *(F.col(c).alias(n) for c, n in names.items()), *(c.alias(n) for n, c in more.items()))
    return df


# The features of an account, each of a key level and of a statistic before the row.
ACCOUNT_FEATURES = (
    *(("acct", c) for c in ("1h_cnt", "24h_cnt", "7d_cnt", "24h_sum", "24h_mean", "7d_mean", "7d_std", "hist_cnt", "hist_mean", "hist_std", "ratio", "z", "gap", "k5_distinct", "k3_distinct")),
    *(("addr", c) for c in ("24h_cnt", "7d_cnt", "7d_mean", "gap")),
    *(("card", c) for c in ("24h_cnt", "7d_cnt", "7d_mean", "hist_cnt", "ratio", "gap")),
)


def account_inputs() -> list[tuple[str, str]]:
    """(level, statistic) that account_features reads: all but ratio and z, and the history means of these."""
    return [*(x for x in ACCOUNT_FEATURES if x[1] not in ("ratio", "z")), ("card", "hist_mean")]


def account_features(wide: DataFrame, amount: str) -> DataFrame:
    """wide, with <level>_<statistic> columns, and its ratios and z-scores of the amount."""
    a, out = F.col(amount), {}
    for level, stat in ACCOUNT_FEATURES:
        mean, std = F.col(f"{level}_hist_mean"), F.col(f"{level}_hist_std")
        if stat in ("ratio", "z"):
            out[f"{level}_{stat}"] = safe_ratio(a, mean) if stat == "ratio" else safe_ratio(a - mean, std)
    return wide.withColumns(out)


def account_block(df: DataFrame, keys: dict[str, str], t: str, amount: str, others: dict[str, str]) -> DataFrame:
    """df with the account features of its three keys, `others` (two names to columns) counted for acct alone."""
    given = df
    for level, key in keys.items():
        stats = [c for p, c in account_inputs() if p == level]
        labels = {c.rsplit("_", 1)[0] for c in stats if c.endswith(STATS)}
        windows = {label: s for label, s in {"1h": HOUR, "24h": DAY, "7d": 7 * DAY, "hist": None}.items() if label in labels}
        distinct = {name: c for name, c in others.items() if f"{name}_distinct" in stats}
        plain = tuple(label for label in windows if f"{label}_mean" not in stats and f"{label}_std" not in stats)
        found = by_rows_of_key(df, key, t, amount, windows, distinct=distinct, source=given, plain=plain)
        df = found.select(*df.columns, *(F.col(c).alias(f"{level}_{c}") for c in stats))
    return account_features(df, amount)


def history_lookup(requests: DataFrame, history_rows: DataFrame, key: str, t: str, amount: str, id: str, windows: dict[str, int | None]) -> DataFrame:
    """For each request, aggregates of strictly earlier history rows of its key: id, t, counts, sums, gap.

    Requests and history go by key and time bucket: no pair of a request and a history row is formed, and a hot key
    is dealt over its buckets. A null key is a key of its own.
    """
    both = requests.select(F.col(id).alias("_id"), F.col(key).alias("_k0"), F.col(t).alias("_at"), F.lit(None).cast("double").alias("_a"), F.lit(False).alias("_h"))
    both = both.union(history_rows.select(F.lit(None), F.col(key), F.col(t), F.col(amount).cast("double"), F.lit(True)))
    out = segmented(both, "_k0", "_at", "_a", windows, real=F.col("_h"), plain=tuple(windows)).where("NOT _h")
    return out.select(F.col("_id").alias(id), F.col("_at").alias(t), *(F.col(f"{label}_{n}").alias(f"{n}_{label}") for label in windows for n in ("cnt", "sum")), "gap")


def trailing_mean(x: str, order: str, rows: int, by: tuple[str, ...] = (), least: int = 1) -> Column:
    """Mean of x over the last `rows` rows, null with fewer than `least` values."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def persistent(condition: Column, order: str, rows: int, by: tuple[str, ...] = ()) -> Column:
    """Whether condition has held on the last `rows` rows."""
    w = Window.partitionBy(*by).orderBy(order)
    return (F.row_number().over(w) >= rows) & (F.min(condition.cast("int")).over(w.rowsBetween(-(rows - 1), 0)) == 1)


def top_by(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
