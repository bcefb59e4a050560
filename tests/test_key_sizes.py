"""Keys of few rows go by sliding frames, hot ones by segments: the same numbers, whatever the bound between them."""

import math

import pytest

from riskframe.operators import windows as W

WINDOWS = {"h": 3_600, "d": 86_400, "all": None}
#: A hot key with ties, a calm one, a null one, NaN and null values; the key "odd" has a null time.
ROWS = [(i, [None, "hot", "hot", "calm"][i % 4], 1_700 * (i // 3), None if i % 11 == 0 else math.nan if i % 13 == 0 else i * 0.37, "xyz"[i % 3] if i % 5 else None) for i in range(160)]
ROWS += [(200 + i, "odd", None if i == 2 else 900 * i, 1.5 * i, "x") for i in range(6)]


@pytest.mark.parametrize("few", [0, 50, 1_000])
def test_the_bound_changes_nothing(spark, monkeypatch, few):
    df = spark.createDataFrame(ROWS, "id int, key string, t long, v double, o string")
    given = {"distinct": {"o": "o"}, "plain": ("h",)}
    want = W.segmented(df, "key", "t", "v", WINDOWS, **given)
    monkeypatch.setattr(W, "FEW", few)
    found = W.by_rows_of_key(df, "key", "t", "v", WINDOWS, **given)
    assert found.dtypes == want.dtypes
    a, b = ({r["id"]: r for r in d.drop("v").collect()} for d in (found, want))
    assert len(a) == len(ROWS) and a.keys() == b.keys()
    for i in a:
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a[i], b[i], strict=True)), (a[i], b[i])


def test_few_rows_are_not_multiplied(spark):
    """Without a hot key no row is shuffled once for each window."""
    df = spark.createDataFrame([r for r in ROWS if r[1] != "odd"], "id int, key string, t long, v double, o string")
    plan = W.entity_aggregates(df, {"acct": "key"}, "t", "v", {"o": "o"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" in plan
