"""Hard negatives: cover trees against scans of all points, and the mined rows against brute force on Spark."""

import numpy as np
import pytest

from smogline.llm import common, hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int, part string"


def points(rng, n, d, centres, spread=3):
    at = rng.integers(-60, 60, size=(centres, d))
    return (at[rng.integers(0, centres, n)] + rng.integers(-spread, spread + 1, size=(n, d))).astype(float)


def test_nodes_cover_their_points():
    rng = np.random.default_rng(2)
    for n, d, c in ((1, 3, 1), (40, 3, 4), (900, 4, 30), (700, 16, 5)):
        x = points(rng, n, d, c)
        tree = hardneg.build_tree(np.arange(n), x)
        assert sorted(tree.ids.tolist()) == list(range(n))
        assert (x[tree.ids] == tree.x).all()
        lifted = np.column_stack([tree.x, np.sqrt(np.maximum(tree.norm ** 2 - (tree.x ** 2).sum(axis=1), 0))])
        for node, first, end in tree.leaves:
            while node >= 0:                                              # a leaf's points lie within all nodes above it
                parent, centre, radius = tree.nodes[int(node)]
                cosine = lifted[first:end] @ lifted[int(centre)] / max(tree.norm ** 2, 1)
                assert (np.arccos(np.clip(cosine, -1, 1)) <= radius + 1e-3).all()
                node = parent


def test_search_equals_a_scan_and_prunes():
    rng = np.random.default_rng(1)
    least = 1.0
    for trial in range(40):
        n, d = int(rng.integers(1, 700)), int(rng.integers(1, 12))
        x = points(rng, n, d, int(rng.integers(1, 20)))
        if trial % 5 == 0:
            x[:n // 2] = x[0]                                             # copies and ties
        if trial % 7 == 0:
            x[:] = 0
        ids = rng.permutation(2 * n)[:n].astype(np.int64)
        q = x[rng.integers(0, n, 12)] + rng.integers(-2, 3, size=(12, d))
        own = ids[rng.integers(0, n, 12)]
        scores = q @ x.T
        low = np.stack([np.floor(np.quantile(scores, f, axis=1)) for f in (0.3, 0.8, 0.0)], axis=1)
        high = np.stack([np.floor(np.quantile(scores, f, axis=1)) for f in (0.6, 1.0, 1.0)], axis=1)
        best = hardneg.Best(low, high, 7)
        tree = hardneg.build_tree(ids, x)
        least = min(least, hardneg.search(tree, q, own, best, np.arange(12)) / (12 * n))
        for i in range(12):
            for w in range(3):
                want = sorted((-int(s), int(k)) for s, k in zip(scores[i], ids) if low[i, w] <= s <= high[i, w] and k != own[i])
                got = [(-int(s), int(k)) for s, k in zip(best.score[i, w], best.id[i, w]) if s != hardneg.NONE]
                assert got == want[:7]
    assert least < 0.5


def brute(rows):
    fine = [(i, np.floor(256.0 * np.array(v, dtype=np.float64)), (g + 1) % 10 if i % 7 == 0 else g)
            for i, v, g in rows if i is not None and g is not None and v is not None
            and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, va, ga in fine:
        if a % 100:
            continue
        score = [(int(va @ v), i, g) for i, v, g in fine if i != a]
        for ps, pid, _ in sorted((s for s in score if s[2] == ga), key=lambda s: (-s[0], s[1]))[:5]:
            near = sorted((s for s in score if s[2] != ga and 30 * ps <= 100 * s[0] <= 90 * ps), key=lambda s: (-s[0], s[1]))
            out += [(a, pid, r, i, ps, s) for r, (s, i, _) in enumerate(near[:10], 1)]
    return sorted(out)


def mined(spark, rows):
    common.ship(spark)
    frame = spark.createDataFrame([(i, v, g, "x", 1, "y") for i, v, g in rows], SCHEMA).repartition(3)
    moved = frame.selectExpr("*", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS moved")
    held = common.cut_lineage(hardneg.usable(moved, "vec_id", "embedding", "moved"), "test")
    found = hardneg.mine(held, held.where("id % 100 = 0"))
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["id"], r["positive_score"], r["score"]) for r in found.collect())


@pytest.mark.parametrize("shard", [2048, 40])
def test_mined_rows_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", shard)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 4)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in np.float32(rng.normal(size=8) / 3)], int(3 if rng.random() < 0.4 else rng.integers(0, 10)))
            for i in range(1500)]
    rows[50:90] = [(i, rows[100][1], g) for i, _, g in rows[50:90]]       # copies of an anchor: ties by id
    rows[200] = (200, None, 1)
    rows[300] = (300, rows[300][1], None)
    rows[400] = (400, [float("nan")] + rows[400][1][1:], 2)
    rows[500] = (500, [None] + rows[500][1][1:], 2)
    rows[600] = (600, [0.0] * 8, 3)
    rows.append((None, rows[5][1], 3))
    assert mined(spark, rows) == brute(rows)


def test_blocks_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-5, 6, size=4)], i % 3) for i in range(400)]
    assert mined(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0, 0.5], 1)]) == []
    few = [(100, [1.0, 0.5], 1), (101, [1.0, 0.0], 1), (102, [0.5, 0.0], 2), (103, [-1.0, 0.0], 2), (104, [], 2)]
    assert mined(spark, [r for r in few if r[1]]) == brute([r for r in few if r[1]])
    assert mined(spark, few) == brute([r if r[1] else (r[0], [0.0, 0.0], r[2]) for r in few])
