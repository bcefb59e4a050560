"""Neighbours of whole tables against brute force."""

import numpy as np
import pytest

from riskframe.operators import neighbours as N


def plain(keys, x, k):
    out = {}
    for at in range(0, len(keys), 500):
        far = np.round(N.apart(x[at : at + 500], x), N.DIGITS)
        far[keys[at : at + 500, None] == keys[None]] = np.inf
        order = np.lexsort((np.broadcast_to(keys, far.shape), far), axis=1)[:, :k]
        for i, row in enumerate(order):
            out[int(keys[at + i])] = x[[j for j in row if np.isfinite(far[i, j])]].tolist()
    return out


@pytest.mark.parametrize(("n", "width", "block", "chunk"), [(20_000, 3, 256, 4_096), (600, 2, 16, 64), (3, 2, 16, 64)])
def test_neighbours_by_brute_force(spark, n, width, block, chunk):
    """A third of the rows are one point, others lie on a grid: many ties."""
    r = np.random.default_rng(n)
    x = np.where(r.random((n, 1)) < 0.5, r.normal(size=(n, width)), r.integers(0, 4, (n, width)).astype(float))
    x[: n // 3] = 1.5
    keys = r.permutation(n)
    df = spark.createDataFrame(list(zip(keys.tolist(), x.tolist(), strict=True)), "key long, x array<double>").repartition(4)
    found = {q["key"]: q["near"] for q in N.nearest(df, 5, block, chunk).collect()}
    want = plain(keys, x, 5)
    assert set(found) == set(want)
    assert all(np.allclose(found[i], want[i]) for i in want)


def test_blocks_meet_where_they_must():
    """Three blocks: near, touching, and far away; and blocks of one repeated point, which meet that of the least keys."""
    centres = np.array([[0.0, 0.0], [3.0, 0.0], [100.0, 0.0]])
    assert N.meetings(centres, np.array([1.0, 1.0, 1.0]), np.array([1.0, 4.0, 4.0]), [0, 5, 9], [4, 8, 12]) == [[0], [0, 1], [2]]
    same = N.meetings(np.zeros((4, 2)), np.zeros(4), np.zeros(4), [0, 10, 20, 30], [5, 15, 25, 35])
    assert same == [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3]]


def test_no_rows_have_no_neighbours(spark):
    assert N.nearest(spark.createDataFrame([], "key long, x array<double>"), 5).collect() == []
    assert [tuple(r) for r in N.nearest(spark.createDataFrame([("a", [1.0])], "key string, x array<double>"), 5).collect()] in ([], [("a", [1.0], [])])


def test_crowded_blocks_meet_where_neighbours_are_nearer():
    """Blocks closer than a thousandth: the second may hold a nearer point, whatever its keys."""
    centres, radius = np.array([[0.0], [0.002]]), np.array([0.0005, 0.0005])
    assert N.meetings(centres, radius, np.array([1.5e-6, 1.5e-6]), [0, 9], [5, 12]) == [[0, 1], [0, 1]]


def test_blocks_meet_few_others():
    """Blocks are cut by place, so that the pairs of blocks that meet grow as the blocks do."""
    x = np.random.default_rng(0).normal(size=(16_384, 2))
    blocks = N.halves(x, 128)
    assert sorted(np.concatenate(blocks).tolist()) == list(range(len(x)))
    centres = np.array([x[b].mean(0) for b in blocks])
    radius = np.array([np.sqrt(N.apart(c[None], x[b]).max()) for c, b in zip(centres, blocks, strict=True)])
    reach = np.array([np.sort(N.apart(x[b], x[b]), axis=1)[:, 5].max() for b in blocks])
    met = N.meetings(centres, radius, reach, [0] * len(blocks), [1] * len(blocks))
    assert sum(map(len, met)) < len(blocks) ** 2 / 4 and N.cell_of(x, N.cuts(x, 3)).max() == 7
