import re

import pytest

from lectern.llm import mixing
from tests.llm.conftest import documents


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(cap * sizes[s] for s in fixed)
        target = {s: cap * sizes[s] if s in fixed else left * w[s] / sum(w[r] for r in rest) for s in order}
        over = [s for s in rest if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target
        fixed |= set(over)


def mixed(spark, texts, source, **kw):
    return mixing.mix(documents(spark, texts, source=source, **kw)).collect()


def test_targets_copies_and_counts(spark):
    texts, source = [], []
    for i in range(600):
        s = ["hot", "b", None, "d", "tiny", "Ä"][i % 6 if i > 300 else 0]
        texts.append("w " * (1 + (i * 37) % 90))
        source.append(s)
    rows = mixed(spark, texts, source)
    sizes = {}
    for t, s in zip(texts, source):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
    again = mixed(spark, texts, source)
    key = lambda rs: sorted((r["doc_id"], r["taken"]) for r in rs)
    assert key(rows) == key(again)


def test_many_equal_documents_of_one_source(spark):
    n = 9000                     # several buckets of one stratum
    rows = mixed(spark, ["same words here"] * n + ["other"] * 50, ["hot"] * n + ["z"] * 50)
    hot = [r for r in rows if r["source"] == "hot"]
    assert len(rows) == n + 50 and abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 3
    assert max(r["copies"] for r in hot) - min(r["copies"] for r in hot) <= 1


def test_odd_rows(spark):
    rows = mixed(spark, [None, "", " \t", "a b", "a b"], ["s", None, "s", None, None], ids=[1, None, 3, 4, 4])
    assert len(rows) == 5 and sum(r["taken"] for r in rows) == sum(r["size"] for r in rows) == 4
    assert mixed(spark, [], []) == []


def test_base_rates_and_caps_need_several_steps(spark):
    from pyspark.sql import functions as F
    docs = documents(spark, ["w " * (5 + i % 7) for i in range(400)], source=["a"] * 100 + ["b"] * 300)
    rows = mixing.mix(docs, base=F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)).collect()
    for s in "ab":
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 12
        assert max(r["rate"] for r in mine) <= 3


def test_repeated_rows_of_the_mix(spark):
    docs = documents(spark, ["a b c"] * 10 + ["d"] * 30, source=["x"] * 10 + ["y"] * 30)
    m = mixing.mix(docs)
    out = mixing.repeated(m, ["doc_id", "text"])
    assert out.count() == sum(r["copies"] for r in m.collect())
