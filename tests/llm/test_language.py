import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import language as L
from lectern.llm.common import crc_mod, text_bytes
from tests.llm.conftest import documents


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


SYLLABLES = {"aa": "the ing er an to".split(), "bb": "ció ñar que es lo".split(), "cc": "sch üng ei das ver".split()}


def corpus(n, seed):
    rng = random.Random(seed)
    lang = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return [words(rng, SYLLABLES[x], rng.randrange(5, 60)) for x in lang], lang


def test_gradients_match_finite_differences():
    net = L.Network(["a", "b", "c"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, offsets = text_bytes(pa.array(["abca", "bb", "cabbage"]))
    s, e, row = L.letter_runs(data, offsets)
    x, n = L.batch_of(data, s, e)
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, n, y)
    rng = np.random.default_rng(0)
    for k in net.w:
        flat = net.w[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(g[k].reshape(-1)) > 0), 6):
            keep, h = flat[i], 1e-4
            flat[i] = keep + h
            up = net.gradients(x, n, y)[0]
            flat[i] = keep - h
            down = net.gradients(x, n, y)[0]
            flat[i] = keep
            assert (up - down) / (2 * h) == pytest.approx(g[k].reshape(-1)[i], rel=1e-4, abs=1e-9)


def test_padding_does_not_change_a_run():
    net = L.Network(["a", "b"], hidden=4)
    data, offsets = text_bytes(pa.array(["abc", "abcdefghijklmnop"]))
    s, e, _ = L.letter_runs(data, offsets)
    both = net.run_sums(data, s, e)
    assert np.allclose(both[0], net.run_sums(data, s[:1], e[:1])[0], atol=1e-6)
    assert np.allclose(both.sum(axis=1), e - s, atol=1e-4)


def test_runs_cover_all_letters():
    text = "a1b " + "é" * 100 + "," + "x" * 97
    data, offsets = text_bytes(pa.array([text, None, "z"]))
    s, e, row = L.letter_runs(data, offsets)
    assert (e - s).tolist() == [1, 1, 200, 97, 1] and row.tolist() == [0, 0, 0, 0, 2]
    s, e, row = L.letter_runs(data, offsets, L.WINDOW)
    assert (e - s).max() <= L.WINDOW and (e - s).sum() == 2 + 200 + 97 + 1 and row[-1] == 2


def plain_sums(net, run):
    """A forward pass over one run, byte by byte."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    states = {}
    for d in "fb":
        state, out, h = np.zeros(net.h), [], net.h
        for c in (run if d == "f" else run[::-1]):
            a = net.w["x" + d][c] + net.w["b" + d]
            zq = sig(a[:2 * h] + state @ net.w["u" + d][:, :2 * h])
            new = np.tanh(a[2 * h:] + (zq[h:] * state) @ net.w["u" + d][:, 2 * h:])
            state = (1 - zq[:h]) * state + zq[:h] * new
            out.append(state)
        states[d] = out if d == "f" else out[::-1]
    logit = np.concatenate([states["f"], states["b"]], axis=1) @ net.w["o"] + net.w["ob"]
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    return (p / p.sum(axis=1, keepdims=True)).sum(axis=0)


def test_runs_of_any_length_equal_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    net = L.Network(["a", "b", "c"], hidden=5, seed=2)
    texts = [bytes(rng.choice(np.flatnonzero(L.LETTER), n).astype(np.uint8))
             for n in (1, 47, 48, 49, 95, 96, 97, 500, 2000, 2000, 3, 144)]
    data = np.frombuffer(b"1".join(texts), np.uint8)
    s, e, _ = L.letter_runs(data, np.array([0, len(data)]))
    assert len(s) == len(texts)
    want = np.array([plain_sums(net, t) for t in texts])
    np.testing.assert_allclose(net.run_sums(data, s, e), want, rtol=1e-4, atol=1e-4)
    np.testing.assert_allclose(net.run_sums(data, s, e, block=5), want, rtol=1e-4, atol=1e-4)


def test_pooled_probabilities_equal_a_plain_forward_pass(spark):
    texts, lang = corpus(60, 5)
    data = pd.DataFrame({"lang": lang, "runs": [t.encode().hex() for t in texts]})
    net = L.train(data, hidden=4, steps=20)
    long = "schüngei" * 300
    got = L.classify(documents(spark, [*texts[:5], long + " the", "1 2"]), net).orderBy("doc_id").collect()
    for r, t in zip(got, [*texts[:5], long + " the"]):
        total = sum(plain_sums(net, w.encode()) for w in t.split())
        assert r["lang_pred"] == net.labels[int(total.argmax())] and r["score"] == pytest.approx(total.max() / total.sum(), abs=2e-5)
    assert got[-1]["lang_pred"] == L.UNDETERMINED


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    docs = documents(spark, ["ab cd"] * 6).withColumn("lang", F.expr("element_at(array('x', 'x', 'y', 'y', 'y', 'z'), cast(doc_id + 1 as int))"))
    assert set(L.training_sample(docs, F.lit(True))["lang"]) == {"x", "y"}


def test_held_out_accuracy_on_spark(spark):
    texts, lang = corpus(400, 3)
    docs = documents(spark, texts, lang=lang)
    sample = L.training_sample(docs, crc_mod("doc_id", 5) != 0, docs_per_label=60, runs_per_doc=40)
    assert sample.groupby("lang").size().max() <= 60
    net = L.train(sample, steps=120)
    rows = L.classify(docs, net).orderBy("doc_id").collect()
    assert sum(r["lang_pred"] == x for r, x in zip(rows, lang)) >= 0.97 * len(lang)
    assert all(0 <= r["score"] <= 1 for r in rows) and set(rows[0].asDict()) >= {"source", "size", "lang"}
    again = L.classify(docs, net).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in rows], [r["score"] for r in again], atol=2e-6)


def test_odd_rows_and_missing_labels(spark):
    texts = [None, "", "123 !!! 456", "the ing", "的 中文", "the " * 40000, "the ing", "\n"]
    docs = documents(spark, texts, lang=[None, None, "aa", "aa", None, "aa", "bb", "bb"], ids=[0, 1, None, 3, 4, 5, 6, 6])
    net = L.train(L.training_sample(docs, crc_mod("doc_id", 5) >= 0), steps=5)
    rows = [(r["text"], r["lang_pred"], r["score"]) for r in L.classify(docs, net).collect()]
    assert len(rows) == len(texts)
    for t, label, score in rows:
        if t in (None, "", "123 !!! 456", "\n"):
            assert (label, score) == (L.UNDETERMINED, 0.0)
        else:
            assert label in ("aa", "bb") and 0 < score <= 1
    nothing = L.train(L.training_sample(docs.filter("false"), crc_mod("doc_id", 5) >= 0))
    assert {r["lang_pred"] for r in L.classify(docs, nothing).collect()} == {L.UNDETERMINED}
    assert L.classify(documents(spark, []), net).collect() == []


def test_one_label_alone():
    net = L.train(pd.DataFrame({"lang": ["x"], "runs": [b"abc de".hex()]}), steps=3)
    assert net.labels == ["x"]
