"""Ragged top-k and the growing vector index against plain versions."""

import os

import numpy as np
import pytest

from lectern.operators import knn
from lectern.sources import cluster_index as ci


def vectors(spark, x, first=0):
    rows = [(first + i, [float(v) for v in r]) for i, r in enumerate(np.asarray(x, dtype=np.float32))]
    return spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")


def queries(spark, q, ks):
    return spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(q, ks))],
                                 "qid LONG, qvec ARRAY<DOUBLE>, k INT")


def plain(x, q, ks, ids=None):
    x = np.asarray(x, dtype=np.float32).astype(float)
    ids = np.arange(len(x)) if ids is None else ids
    out = set()
    for i, (v, k) in enumerate(zip(np.asarray(q), ks)):
        d = np.round(((x - v) ** 2).sum(axis=1), 12)
        for rk, j in enumerate(np.lexsort((ids, d))[:k], 1):
            out.add((i, int(ids[j]), rk))
    return out


def rows(hits):
    got = [(r["qid"], r["vec_id"], r["rk"]) for r in hits.collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(rng, n, dim=8, centres=40, spread=0.05):
    return rng.standard_normal((centres, dim))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))


@pytest.mark.parametrize("cap", [knn.DEFAULT_BROADCAST_CAP, 8 * 6 * 10])
def test_every_query_has_its_own_k(spark, cap):
    rng = np.random.default_rng(1)
    x, q = rng.integers(0, 3, (300, 6)).astype(float), rng.integers(0, 3, (37, 6)).astype(float)
    ks = rng.integers(1, 12, 37)
    ks[5], ks[6] = 299, 5000
    got = knn.nearest(vectors(spark, x), queries(spark, q, ks), k_col="k", broadcast_cap=cap)
    assert rows(got) == plain(x, q, ks)


def test_one_very_large_k_costs_the_others_nothing():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((30_000, 4)), rng.standard_normal((1001, 4))
    ks = np.full(1001, 5)
    ks[500] = 10_000
    top, looked = knn.TopK(q, ks), []
    merge = top._merge
    top._merge = lambda a, d, i: (looked.append(np.bincount(a, minlength=1001)), merge(a, d, i))
    for s in range(0, len(x), 2000):
        top.add(x[s:s + 2000], np.arange(s, s + 2000))
        assert len(top.held_q) <= ks.sum()
    assert np.bincount(top.held_q, minlength=1001).tolist() == ks.tolist()
    others = np.delete(sum(looked), 500)
    assert others.mean() < 60       # candidates of 30,000 rows, for k = 5
    want = np.lexsort((np.arange(30_000), np.round(((x - q[500]) ** 2).sum(axis=1), 12)))[:10_000]
    assert set(top.held_i[top.held_q == 500].tolist()) == set(want.tolist())


def test_more_queries_with_one_id_than_a_block_holds(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 4))
    same = spark.createDataFrame([(7, [float(v) for v in x[1]])] * 40, "qid LONG, qvec ARRAY<DOUBLE>")
    got = knn.nearest(vectors(spark, x), same, k=1, broadcast_cap=8 * 4 * 6).collect()
    assert [(r["qid"], r["vec_id"]) for r in got] == [(7, 1)]


def test_k_below_one_is_refused(spark):
    x = vectors(spark, [[0.0, 1.0]])
    with pytest.raises(Exception, match="k must be >= 1"):
        knn.nearest(x, queries(spark, [[0.0, 1.0]], [0]), k_col="k").collect()
    with pytest.raises(ValueError):
        knn.nearest(x, queries(spark, [[0.0, 1.0]], [1]), k=0)


def test_clustered_vectors_are_found_without_reading_half(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = clustered(rng, 6000)
    q = x[::100] + 0.01 * rng.standard_normal((60, 8))
    ks = rng.integers(1, 9, 60)
    ci.build(vectors(spark, x), str(tmp_path), unit_rows=150)
    hits, report = ci.search(spark, str(tmp_path), queries(spark, q, ks), k_col="k")
    assert rows(hits) == plain(x, q, ks)
    assert report["pairs_read"] < 0.5 * report["pairs"] and report["units"] > 40
    hits, report = ci.search(spark, str(tmp_path), queries(spark, q[:3], ks[:3]), k_col="k", broadcast_cap=1)
    assert rows(hits) == plain(x, q[:3], ks[:3]) and report["units_read"] < 0.5 * report["units"]


def test_add_search_compact_vacuum(spark, tmp_path):
    rng = np.random.default_rng(5)
    root = str(tmp_path)
    x = np.concatenate([clustered(rng, 700), np.tile(clustered(rng, 1), (300, 1)), 9 + clustered(rng, 200)])
    q, ks = np.concatenate([x[::97], rng.standard_normal((5, 8)) * 20]), np.full(18, 6)
    ks[3] = 5000
    q = q[:18]
    empty = ci.search(spark, root, queries(spark, q, ks), k_col="k")[0]
    assert empty.collect() == [] and ci.next_vec_id(spark, root) == 0
    ci.add(vectors(spark, x[:500]), root, unit_rows=64)                 # the first one builds
    files = {str(f) for f in (tmp_path / "vectors").rglob("*.parquet")}
    ci.add(vectors(spark, x[500:1000], 500), root, unit_rows=64)
    ci.add(vectors(spark, x[:0]), root)                                 # nothing
    ci.add(vectors(spark, x[1000:], ci.next_vec_id(spark, root)), root, unit_rows=64)
    assert files <= {str(f) for f in (tmp_path / "vectors").rglob("*.parquet")}
    want = plain(x, q, ks)
    assert rows(ci.search(spark, root, queries(spark, q, ks), k_col="k")[0]) == want
    assert len(ci.manifest(spark, root)["parts"]) == 3
    ci.compact(spark, root, unit_rows=64)
    assert len(ci.manifest(spark, root)["parts"]) == 1 and ci.vacuum(spark, root) > 0
    hits, report = ci.search(spark, root, queries(spark, q, ks), k_col="k")
    assert rows(hits) == want and ci.read_vectors(spark, root).count() == len(x)
    # 300 equal vectors are several units.
    assert report["units"] > 300 / 64
    with pytest.raises(ValueError, match="length"):
        ci.add(spark.createDataFrame([(9, [1.0, 2.0])], "vec_id LONG, embedding ARRAY<FLOAT>"), root)


def test_of_two_writers_one_comes_first_and_nothing_is_lost(spark, tmp_path):
    rng = np.random.default_rng(6)
    root, x = str(tmp_path), clustered(rng, 300)
    ci.build(vectors(spark, x[:100]), root)
    base = ci.manifest(spark, root)
    ci.add(vectors(spark, x[100:200], 100), root)
    with pytest.raises(ci.Conflict):
        ci.commit(spark, root, base, base["parts"])
    # A writer that began on the old manifest ends on the new one.
    late = dict(ci._write_part(vectors(spark, x[200:], 200), root, ci.read_pivots(spark, root, base["parts"][0]["pivots"]),
                               base["parts"][0]["pivots"], 100, 64))
    ci.publish(spark, root, lambda parts: parts + [late], base)
    assert ci.manifest(spark, root)["version"] == 3
    q = x[::29]
    assert rows(ci.search(spark, root, queries(spark, q, [3] * len(q)), k_col="k")[0]) == plain(x, q, [3] * len(q))
    # A manifest that is only half written doesn't count yet.
    half = tmp_path / "manifest" / "00000004.json"
    half.write_text('{"version": 4, "pa')
    now = ci.manifest(spark, root)
    assert (now["version"], now["next"]) == (3, 4)
    with pytest.raises(ci.Conflict):
        ci.commit(spark, root, now, now["parts"])
    # Its writer is lost: the next one goes behind it.
    os.utime(half, (1, 1))
    assert ci.publish(spark, root, lambda parts: parts)["version"] == 5
    assert ci.manifest(spark, root)["version"] == 5 and len(ci.manifest(spark, root)["parts"]) == 3
