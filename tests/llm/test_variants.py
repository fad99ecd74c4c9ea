"""Spelling variants against a plain version of the whole contract."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import variants as V
from lectern.llm.catalog import misspelt, op11_spelling_variants
from tests.llm.conftest import documents

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Exactly one insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_count(texts, ids):
    count = Counter()
    for i, t in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def plain_group(words):
    by_len = {}
    for w in words:
        by_len.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        close = [x for k in (-1, 0, 1) for x in by_len.get(len(w) + k, []) if x != w and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x)) if close else None
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (form, n, len(close), words[form] if form is not None else None)
    rows = set()
    for w, (form, n, k, fn) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, k, fn))
    return rows


def rows(df):
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def vocabulary(rng, n, letters="abcdeéÀ÷ÿz", lengths=(5, 9)):
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*lengths)))
        out[w] = rng.randint(3, 60)
        for _ in range(rng.randrange(4)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            x = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:], w[:i] + w[i:][::-1]])
            out[x] = rng.randint(3, 200)
    return out


@pytest.mark.parametrize("options", [{}, {"leaf": 40, "sample": 400}, {"leaf": 60, "block": 7, "sample": 64}])
def test_groups_equal_brute_force(spark, options):
    words = vocabulary(random.Random(len(options)), 900)
    df = spark.createDataFrame(list(words.items()), "word STRING, n LONG")
    assert rows(V.group(df, **options)) == plain_group(words)


def test_dense_groups_anagrams_and_long_words(spark):
    rng = random.Random(9)
    base = "abcdefgh"
    words = {base[:i] + c + base[i + 1:]: rng.randint(3, 99) for i in range(8) for c in "abcdefghijklmnop"}
    for _ in range(60):                                   # same letters in another order
        words["".join(rng.sample("lmnopq", 6))] = rng.randint(3, 9)
    words.update({"x" * 3000: 3, "x" * 3001: 9, "x" * 2999 + "y": 4, "aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 14})
    df = spark.createDataFrame(list(words.items()), "word STRING, n LONG")
    for options in ({}, {"leaf": 16, "block": 10, "sample": 100}):
        assert rows(V.group(df, **options)) == plain_group(words)


def test_chains_of_forms(spark):
    words = {"b" * (5 + i): 3 << i for i in range(40)}    # every form leads on to the next
    df = spark.createDataFrame(list(words.items()), "word STRING, n LONG")
    got = rows(V.group(df))
    assert got == plain_group(words) and {r[2] for r in got} == {"b" * 44}


def test_ties_go_to_the_first_in_code_point_order(spark):
    words = {"hause": 3, "hausé": 9, "hausz": 9, "hausa": 9}
    df = spark.createDataFrame(list(words.items()), "word STRING, n LONG")
    got = {r[0]: r for r in rows(V.group(df))}
    assert got["hause"][1] == "hausa" and got == {r[0]: r for r in plain_group(words)}


def test_query_over_documents(spark, tmp_path):
    rng = random.Random(2)
    words = list(vocabulary(rng, 120))
    ids = [*range(200), 7, 7, None, -3, 10 ** 15]
    texts = [" ".join(rng.choice(words).upper() if rng.random() < .1 else rng.choice(words)
                      for _ in range(rng.randrange(200))) for _ in ids]
    texts[3:7] = [None, "", "12 .. 34", "Abc-DEF_ghi " * 40]
    texts[8] = "longer " * 60_000                         # a very long text
    docs = documents(spark, texts, ids=ids).withColumnRenamed("score", "word").withColumnRenamed("size", "n")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(op11_spelling_variants(spark, str(tmp_path)))
    assert got == plain_group(plain_count(texts, ids)) and len(got) > 100


def test_empty_table_and_no_words(spark):
    for texts in ([], [None, "", "ab ab ab", "12345"]):
        docs = documents(spark, texts)
        assert V.group(V.count_words(docs, misspelt)).collect() == []


def test_tree_reaches_every_box_within_the_radius():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 4, (700, V.LETTERS)).astype(np.int32)
    points[:, 6:] = 0
    tree = V.Tree(points, 9)
    q, leaf = tree.reach(points, 2)
    met = set(zip(q.tolist(), leaf.tolist()))
    of = np.empty(len(points), int)
    for k, m in enumerate(tree.members):
        of[m] = k
    for i in range(0, 700, 7):
        close = np.flatnonzero(np.abs(points - points[i]).sum(axis=1) <= 2)
        assert {(i, int(of[j])) for j in close} <= met
    assert len(met) < 0.7 * len(points) * len(tree.members)
