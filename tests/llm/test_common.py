"""Byte helpers, memoised parts and components against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm.common import SPACE, components, run_hashes, runs, text_bytes
from lectern.llm.memo import PartTable, cuts


def test_runs_do_not_cross_rows():
    data, offsets = text_bytes(pa.array(["ab cd", "ef", None, "", " x "]))
    s, e, row = runs(~SPACE[data], offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(s, e)]
    assert words == ["ab", "cd", "ef", "x"] and row.tolist() == [0, 0, 1, 4]


def test_hashes_depend_on_bytes_alone_and_fold_case():
    data, offsets = text_bytes(pa.array(["Foo bar foo", "x" * 3_000_000 + " foo"]))
    s, e, _ = runs(~SPACE[data], offsets)
    h, low = run_hashes(data, s, e), run_hashes(data, s, e, lower=True)
    assert h[0] != h[2] and low[0] == low[2] and h[2] == h[4]
    assert len(set(h.tolist())) == 4


def test_text_bytes_of_slices():
    col = pa.array(["aa", "bbb", None, "cc"]).slice(1, 3)
    data, offsets = text_bytes(col)
    assert data.tobytes() == b"bbbcc" and offsets.tolist() == [0, 3, 3, 5]


def test_parts_tile_rows_and_table_survives_reset():
    texts = ["a b  c", "", "  lead", "x\ny z "]
    data, offsets = text_bytes(pa.array(texts))
    s, e, first = cuts(data, offsets, SPACE)
    for i, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(s[first[i]:first[i + 1]], e[first[i]:first[i + 1]])]
        assert "".join(got) == t and all(re.fullmatch(r"\s*\S+|\s+", p) for p in got)
    table = PartTable(lambda parts: [[len(p), ord(p[0])] for p in parts], max_parts=2)
    for _ in range(3):
        ids, n = table.encode(data, s, e)
        want = [v for a, b in zip(s, e) for v in (b - a, data[a])]
        assert ids.tolist() == want and n.tolist() == [2] * len(s)


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [], [(5, 5)], [(1, 2), (2, 3), (3, 4), (9, 8)], [(0, i) for i in range(1, 60)],
    [(i, i + 1) for i in range(50)], [(-5, 3), (3, -7), (10, 11)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a LONG, b LONG")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {k: v for k, v in plain_components(edges).items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert got == want
