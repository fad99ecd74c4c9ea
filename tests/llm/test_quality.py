import random

import numpy as np
import pyarrow as pa

from lectern.llm import quality as Q
from lectern.llm.common import crc_mod, text_bytes
from tests.llm.conftest import documents

WORDS = "the river runs along a green hill and people walk there every day with their dogs".split()


def sentence(rng, n):
    w = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(x.capitalize() if i % 9 == 0 else x for i, x in enumerate(w)) + "."


def corpus(n, seed=1):
    rng = random.Random(seed)
    texts, label = [], []
    for i in range(n):
        kind = i % 5
        body = sentence(rng, rng.randrange(20, 80))
        texts.append([body, body + "\n" + sentence(rng, 30), body.upper().replace(" ", "!! "),
                      " ".join([rng.choice(WORDS)] * 60), " | ".join(body.split())][kind])
        label.append(int(kind < 2))
    return texts, label


def table(spark, texts, label):
    return documents(spark, texts), spark.createDataFrame(
        [(i, y, 0) for i, y in enumerate(label)], "doc_id LONG, quality INT, toxic INT")


def test_held_out_accuracy(spark):
    texts, label = corpus(500)
    docs, labels = table(spark, texts, label)
    rows = Q.score(docs, Q.fit(docs, labels, crc_mod("doc_id", 3) != 1, sample=100)).withColumn(
        "held", crc_mod("doc_id", 3) == 1).orderBy("doc_id").collect()
    held = [(r["score"] >= 0.5) == bool(label[r["doc_id"]]) for r in rows if r["held"]]
    assert len(held) > 100 and np.mean(held) >= 0.97


def test_votes_equal_a_plain_version():
    texts, label = corpus(120)
    shares = Q.term_shares(*text_bytes(pa.array(texts)))
    v = Q.Voter(shares[:80], np.array(label[:80]), 0.4)
    got = v.scores(shares[80:], neighbours=7)
    for s, g in zip(shares[80:], got):
        x = Q.unit((s @ v.project)[None])[0]
        cos = v.vectors @ x
        near = np.argsort(-cos, kind="stable")[:7]
        w = np.maximum(cos[near], 0) ** Q.SHARPNESS
        assert abs((w * v.labels[near]).sum() / w.sum() - g) < 1e-3


def test_scores_do_not_depend_on_the_rows_of_a_block(spark):
    texts, label = corpus(300)
    texts += texts[:40]                      # equal rows, equal neighbours
    label = [*label, *(1 - y for y in label[:40])]
    docs, labels = table(spark, texts, label)
    voter = Q.fit(docs, labels, crc_mod("doc_id", 3) != 1, sample=60)
    one = {r["doc_id"]: r["score"] for r in Q.score(docs.coalesce(1), voter).collect()}
    many = {r["doc_id"]: r["score"] for r in Q.score(docs.repartition(37), voter).collect()}
    assert one == many and all(one[i] == one[300 + i] for i in range(40))
    shares = Q.term_shares(*text_bytes(pa.array(texts)))
    v = Q.Voter(np.tile(shares[:1], (6, 1)), np.array([1, 1, 0, 0, 0, 0]), 0.4)
    assert v.scores(shares[:1], neighbours=2)[0] == 1.0      # six ties: the first two vote


def test_shares_do_not_depend_on_neighbouring_rows():
    texts, _ = corpus(30)
    whole = Q.term_shares(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.array_equal(whole[i], Q.term_shares(*text_bytes(pa.array([t])))[0])


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "the river " * 30000, "é" * 10, "a"]
    docs = documents(spark, texts, ids=[0, 1, 2, 3, 4, None, 3])
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, None), (None, 1), (99, 0), (2, 7)], "doc_id LONG, quality INT")
    voter = Q.fit(docs, labels, crc_mod("doc_id", 3) >= 0)
    rows = Q.score(docs, voter).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if not r["text"]} == {voter.prior}
    none = Q.fit(docs, labels.filter("false"), crc_mod("doc_id", 3) >= 0)
    assert {r["score"] for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(documents(spark, []), voter).collect() == []
