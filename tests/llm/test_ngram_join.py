import random
import re

from lectern.llm import ngram_join
from tests.llm.conftest import documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = comp[i], comp[j]
                comp = [b if x == a else x for x in comp]
    out = []
    for i in range(len(ids)):
        members = [ids[j] for j in range(len(ids)) if comp[j] == comp[i] and ids[j] is not None]
        out.append((ids[i], len(sets[i]), min(members) if members and sets[i] else ids[i]))
    return sorted(out, key=str)


def run(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    got = ngram_join.join(documents(spark, texts, ids=ids)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(ids, texts)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_near_copies_match_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 30, 120, 400]))]
        texts += [edited(rng, base, k % 5) for k in range(8)]
    run(spark, texts)


def test_large_group_of_near_copies_and_a_chain(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(rng, base, 1) for _ in range(60)]
    # A chain: neighbours are similar, its ends are not.
    words = [f"c{i}" for i in range(100)]
    for k in range(12):
        words = words[3:] + [f"n{k}-{j}" for j in range(3)]
        texts.append(" ".join(words))
    run(spark, texts)


def test_common_lines_link_nothing(spark):
    line = " ".join(f"l{i}" for i in range(20))
    texts = [line + " " + " ".join(f"x{d}-{i}" for i in range(40)) for d in range(50)]
    run(spark, texts)


def test_odd_rows(spark):
    texts = [None, "", "  \n ", "one", "One", "one two three", "ONE two  three", "one two three four",
             "É a b c d", "é a b c d", "word " * 5000, "word " * 4000, " x y", None, "one"]
    ids = list(range(len(texts) - 3)) + [None, 3, 3]
    run(spark, texts, ids)
    assert ngram_join.join(documents(spark, [])).collect() == []


def test_prefixes_of_all_orders_keep_every_link():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = rng.random(len(x)) < 0.07
        y = np.unique(np.concatenate([x[~drop], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)]))
        c = len(np.intersect1d(x, y))
        hot = np.sort(x[: len(x) // 3])
        if len(y) and 100 * c >= 85 * (len(x) + len(y) - c):
            for o in range(3):
                a, b = ngram_join.prefix(x, o, hot), ngram_join.prefix(y, o, hot)
                assert len(np.intersect1d(a, b))
                # Of a set that is not larger, the shorter prefix is enough.
                if len(x) <= len(y):
                    a = a[:ngram_join.lengths(len(x))[1]]
                if len(y) <= len(x):
                    b = b[:ngram_join.lengths(len(y))[1]]
                assert len(np.intersect1d(a, b))


def test_bitmaps_differ_in_at_most_as_many_bits_as_sets_in_tokens():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (1, 30, 400, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))
        a, b = ngram_join.bitmap(x), ngram_join.bitmap(y)
        assert len(a) * 64 == ngram_join.BITS
        assert sum(int(v).bit_count() for v in a ^ b) <= len(np.setxor1d(x, y))
    assert not ngram_join.bitmap(np.zeros(0, np.uint64)).any()


def test_pairs_just_below_the_threshold_do_not_become_rows(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(60):         # two of them share 0.8 of their shingles
        w = list(base)
        i = rng.randrange(10, 60)
        w[i], w[i + 60] = f"e{rng.random()}", f"e{rng.random()}"
        texts.append(" ".join(w))
    seen, write = [], ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "plausible":
            seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    run(spark, texts)
    # Of 1,770 pairs about a tenth are linked or nearly so.
    assert len(seen) == 2 and sum(seen) < 400


def test_one_row_of_each_group_stays(spark):
    texts = ["a b c d e"] * 3 + ["other words that stay here", None, "", "no id one two", "no id three four", "a b c d e"]
    docs = documents(spark, texts, ids=[4, 2, 9, 5, 7, 8, None, None, 2])
    kept = ngram_join.one_of_each(docs, ngram_join.join(docs)).select("doc_id").collect()
    assert sorted((r[0] for r in kept), key=str) == [2, 5, 7, 8, None, None]
