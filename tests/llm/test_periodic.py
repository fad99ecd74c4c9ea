"""Periodic runs against a plain version that compares every pair of words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lectern.llm import periodic as P
from lectern.llm.catalog import op12_periodic_runs
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """(start, length, period) of all runs."""
    n, out, seen = len(w), [], set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if w[i] == w[i + p]:
                j = i
                while j < n - p and w[j] == w[j + p]:
                    j += 1
                if j + p - i >= max(6, 4 * p) and not any(p % q == 0 and (i, j + p, q) in seen for q in range(1, p)):
                    seen.add((i, j + p, p))
                    out.append((i, j + p - i, p))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def contract(doc_id, text):
    words = planted(doc_id, text)
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequence(rng):
    n, k = rng.randrange(0, 420), rng.choice([1, 2, 3, 5, 60])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n < 8:
            break
        a, p, m = rng.randrange(n), rng.randrange(1, n // 3 + 2), rng.randrange(n)
        for i in range(a, min(n, a + m)):
            w[i] = w[a + (i - a) % p]
    return w


def hashes(docs):
    ids = P.mix64(np.arange(1, 5000, dtype=np.uint64))
    return ids[np.array([x for d in docs for x in d], dtype=np.int64)], np.array([len(d) for d in docs], dtype=np.int64)


def test_runs_of_many_texts_equal_brute_force():
    rng = random.Random(1)
    n = 0
    for _ in range(60):
        docs = [sequence(rng) for _ in range(8)]
        got = P.text_runs(*hashes(docs))
        for d, g in zip(docs, got):
            want = brute(d)
            assert g == want
            n += len(want)
    assert n > 500


def test_nested_periods_and_strings_without_small_ones():
    fib, nxt = [0], [0, 1]
    while len(nxt) < 700:
        fib, nxt = nxt, nxt + fib
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    cases = [nxt, thue, ([0] * 40 + [1]) * 6, (([0, 1] * 20 + [2]) * 5 + [3]) * 5, [0] * 500, [0] * 5, [0] * 6,
             [0, 1] * 4, [0, 1] * 3 + [0], list(range(200)) * 4, list(range(200)) * 4 + [0], list(range(99)) * 3 + list(range(98)),
             thue * 5, [7] + list(range(64)) * 9 + [7]]
    for got, d in zip(P.text_runs(*hashes(cases)), cases):
        assert got == brute(d)


@pytest.mark.parametrize("period", [9, 16, 17, 31, 32, 33, 64, 65, 100, 127, 128, 129])
def test_run_of_exactly_four_periods_is_found_and_one_word_less_is_not(period):
    rng = random.Random(period)
    root = [rng.randrange(3) for _ in range(period - 1)] + [9]
    before, after = [11] * 3, [12] * 2
    full, less = before + root * 4 + after, before + (root * 4)[:-1] + after
    a, b = P.text_runs(*hashes([full, less]))
    assert (3, 4 * period, period) in a and a == brute(full) and b == brute(less)


def test_very_long_text():
    rng = random.Random(5)
    root = [rng.randrange(4000) for _ in range(30_011)]
    w = [rng.randrange(4000) for _ in range(5000)] + root * 6 + root[:17]
    assert P.text_runs(*hashes([w]))[0][-1][1:] == (6 * 30_011 + 17, 30_011)


def test_selected_positions_depend_on_their_context_alone_and_leave_no_gap():
    rng = np.random.default_rng(0)
    part = rng.integers(0, 2000, 400)
    w = P.mix64(np.concatenate([part, rng.integers(0, 2000, 77), part]).astype(np.uint64) + np.uint64(1))
    tau, h, size = 16, w, 1
    while size < tau:
        h, size = P.joined(h, size), size * 2
    at = P.synchronising(h, tau, P.small_periods(w, P.DIRECT))
    one, two = at[at <= 400 - 2 * tau], at[at >= 477] - 477
    assert one.tolist() == two[two <= 400 - 2 * tau].tolist()
    assert np.diff(at).max() <= tau and len(at) < 4 * len(w) / tau


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                        "collapsed_sha256")) for r in df.collect()), key=str)


def test_query_equals_contract(spark, tmp_path):
    rng = random.Random(3)
    words = ["a", "b", "ç ", "\x1c", "日本"]
    ids = [*range(260), 7, 7, None, -5, 10 ** 12]
    texts = ["".join(f"{rng.choice(words[:rng.choice([1, 2, 5])])}{rng.choice([' ', chr(9), '  ', chr(13) + chr(10)])}"
                     for _ in range(rng.randrange(0, 130))) for _ in ids]
    texts[10:14] = [None, "", " \n\t ", "x"]
    texts[20] = "one two three " * 20_000                   # a very long text
    docs = documents(spark, texts, ids=ids).withColumnRenamed("score", "runs").withColumnRenamed("size", "collapsed")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    # The long one has one run, of three words; brute force would not end.
    long = rows(op12_periodic_runs(spark, str(tmp_path)))
    want = sorted((contract(i, t) for i, t in zip(ids, texts) if i != 20), key=str)
    assert [r for r in long if r[0] != 20] == want
    assert sum(r[1] for r in want) > 100 and sum(1 for i in ids if planted(i, "q w e r t z u i o p a s") != "q w e r t z u i o p a s".split()) > 10
    top = next(r for r in long if r[0] == 20)
    assert top[4] is not None and top[3] > 10_000


def test_collapsed_texts_and_empty_table(spark):
    got = {r["doc_id"]: r for r in P.detect(documents(spark, ["go  go go\tgo go go now", "a b", None, "", "x " * 6]))
           .collect()}
    assert got[0]["collapsed"] == "go now" and got[0]["n_words"] == 7
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 6, 1)]
    assert got[1]["collapsed"] == "a b" and got[2]["collapsed"] == "" and got[3]["runs"] == [] and got[4]["collapsed"] == "x"
    assert P.detect(documents(spark, [])).collect() == []
