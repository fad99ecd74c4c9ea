"""Hilbert-curve search and spherical-cap filters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import caps, curves


def embeddings(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "clash", 1.0)
                                  for i, v, lab in rows],
                                 "vec_id LONG, embedding ARRAY<FLOAT>, label INT, rank STRING, score DOUBLE")


def test_hilbert_keys_are_a_walk_through_the_grid():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side ** dims))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def brute_top(ids, x, k, step):
    out = {}
    for i, q in zip(ids, x):
        if i % step == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = {int(ids[j]) for j in order}
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_with_many_blocks(spark, scale):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 12))
    x = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 12))
    x = x.astype(np.float32).astype(np.float64)
    if scale:
        x *= rng.uniform(0.5, 2.0, 3000)[:, None]
        x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(3000)
    report = {}
    got = curves.nearest(embeddings(spark, [(int(i), v, 0) for i, v in zip(ids, x)]), 10, F.col("vec_id") % 20 == 0,
                         block=128, report=report).collect()
    want = brute_top(ids, x, 10, 20)
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in got)
    assert report["blocks"] > 10 and hits / (10 * len(want)) >= 0.9
    for r in got:
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    for rows in by.values():
        assert [x[2] for x in rows] == list(range(1, 11)) and rows == sorted(rows)


def test_many_queries_of_a_block_are_shared_out(spark):
    x = np.random.default_rng(4).standard_normal((1500, 8))
    rows = embeddings(spark, [(i, [float(y) for y in v], 0) for i, v in enumerate(x)])
    report = {}
    got = curves.nearest(rows, 5, F.lit(True), block=256, recall=1.0, chunk=200, report=report).collect()
    whole = {}
    want = curves.nearest(rows, 5, F.lit(True), block=256, recall=1.0, chunk=10 ** 9, report=whole).collect()
    assert whole["queries"] > 1000 and report["queries"] <= 300
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5 * 1500


def test_search_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1, 0, 0], 1), (1, [1, 0, 0], 1), (2, [1, 0, 0], 2), (3, None, 1), (4, [0, 0, 0], 1), (20, [0.5, 0.5, 0], 1),
            (5, [nan, 1, 0], 1), (6, [1, None, 0], 1), (7, [1, 0], 1), (8, [float("inf"), 0, 0], 1), (None, [1, 1, 1], 1), (1, [1, 0, 0], 1),
            (40, None, 1)]
    got = curves.nearest(embeddings(spark, rows), 20, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert curves.nearest(embeddings(spark, []), 5, F.lit(True)).collect() == []
    assert curves.nearest(embeddings(spark, rows), 5, F.lit(False)).collect() == []


def brute_links(rows, cosine):
    n = len(rows)
    ok = [v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
          and lab is not None for _, v, lab in rows]
    x = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if k else None
         for (_, v, _), k in zip(rows, ok)]
    links, comp = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and x[i] @ x[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i in range(n):
        c = min(rows[j][0] for j in range(n) if comp[j] == comp[i])
        out.append((rows[i][0], links[i], c, rows[i][0] == c))
    return sorted(out)


@pytest.mark.parametrize("block", [caps.BLOCK, 16])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        base = rng.standard_normal(8)
        for k in range(12):
            rows.append((len(rows), base + rng.choice([0.05, 0.12, 0.2]) * rng.standard_normal(8), c % 3))
    common = rng.standard_normal(8)
    rows += [(len(rows) + k, common, 1) for k in range(70)]
    got = sorted(tuple(r) for r in caps.links(embeddings(spark, rows), block=block).collect())
    assert got == brute_links(rows, caps.COSINE)


def test_links_of_odd_rows(spark):
    nan = float("nan")
    one = [1.0] + [0.0] * 7
    rows = [(0, one, 1), (1, one, 1), (2, [2 * x for x in one], 1), (3, one, None), (4, None, 1), (5, [0.0] * 8, 1),
            (6, [nan] + [0.0] * 7, 1), (7, [None] + [1.0] * 7, 1), (8, [1.0], 1), (9, one, 2), (9, one, 2), (10, [-0.0] * 7 + [1.0], 5),
            (11, [0.0] * 7 + [1.0], 5)]
    got = sorted(tuple(r) for r in caps.links(embeddings(spark, rows)).collect())
    assert got == brute_links(rows, caps.COSINE)
    assert caps.links(embeddings(spark, [])).collect() == []


def test_codes_lose_no_near_pair_and_list_all_that_pass():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = rng.standard_normal((3000, 64))
    n -= (n * x).sum(1)[:, None] * x
    n /= np.linalg.norm(n, axis=1)[:, None]
    f = caps.Filters(64)
    a, b = f.passed(x), f.passed(0.93 * x + np.sqrt(1 - 0.93 ** 2) * n)
    assert (a & b).any(axis=1).all() and a.sum(axis=1).min() >= caps.LEAST
    code = f.codes[0]
    r, d = code.decode(x[:50], np.full(50, 1.0))
    t = x[:50] @ code.turn
    first, second = (t[:, lo:hi] @ w.T for lo, hi, w in zip(code.bounds, code.bounds[1:], code.words))
    want = np.argwhere((first[:, :, None] + second[:, None, :]).reshape(50, -1) > 1.0)
    assert sorted(zip(r.tolist(), d.tolist())) == sorted(map(tuple, want.tolist()))
