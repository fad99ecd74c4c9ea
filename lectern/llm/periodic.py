"""Runs of words that repeat with a period, by string synchronising sets.

A *run* is a stretch of consecutive words with smallest period q (words q
apart are equal), at least ``EXPONENT`` periods and ``LEAST`` words long, that
cannot be extended.

Periods up to ``DIRECT`` are detected on their own: words are compared with
those q places on.  Larger ones are proposed scale by scale.  At scale c (a
power of two) a set of positions is selected by the hashes of the c/2 words
that follow: a position is in the set if, among it and the c/2 positions
after it, the least hash is at either end.  Whether it is selected depends on
its next c words alone, so equal stretches are selected alike; and unless a
stretch of c/2 words has a period of at most an eighth of c, every c/2
positions hold a selected one.  The positions of such highly periodic
stretches are left out; they lie in runs of smaller periods, which the scales
before have found.  A run with a period in (c/2, c] holds a selected position
in its first period, and the next selected position with the same c words is
exactly one period on: such pairs propose the period.  A proposal is extended
word by word to both sides, so what is reported is exact.

Texts of a batch are worked on together, by classes of length, with a word of
its own between any two.  Words are compared by 64-bit hashes.

Defined cases: a text that is null or without words has no run and an empty
collapsed text; a text is worked on whole, whatever its length; repeated rows
get equal results; an empty table gives an empty table; only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import MIX_A, MIX_B, SPACE, bounded_batches, mix64, run_hashes, runs, text_bytes
from lectern.llm.repeats import sliding_least

EXPONENT = 4        # periods of a run at least
LEAST = 6           # words of a run at least
DIRECT = 8          # periods up to here are detected by comparing words
HIGH = 4            # a stretch is highly periodic if its period fits it this often

_NONE = np.uint64(np.iinfo(np.uint64).max)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    return edge[::2], edge[1::2]


def small_periods(w: np.ndarray, upto: int) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of the runs with periods up to ``upto``."""
    out, seen = [], {}
    for p in range(1, min(upto, len(w) - 1) + 1):
        a, b = _stretches(w[p:] == w[:-p])
        long = b - a + p >= max(LEAST, EXPONENT * p)
        for s, e in zip(a[long].tolist(), (b[long] + p).tolist()):
            # The same stretch under a divisor of p: p is not its smallest period.
            if not any(p % q == 0 for q in seen.get((s, e), ())):
                seen.setdefault((s, e), []).append(p)
                out.append((s, e, p))
    return out


def joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 * size words from those of size words."""
    return mix64(h[:-size] * MIX_A + (mix64(h[size:]) ^ MIX_B))


def synchronising(h: np.ndarray, tau: int, periodic: list[tuple[int, int, int]]) -> np.ndarray:
    """Selected positions; ``h`` holds hashes of tau words.  ``periodic``: the
    runs found so far, whose stretches of small period are left out."""
    low = np.zeros(len(h) + 1, np.int64)
    for s, e, p in periodic:
        if HIGH * p <= tau and e - s >= tau:
            low[s] += 1
            low[e - tau + 1] -= 1
    masked = np.where(np.cumsum(low)[:-1] > 0, _NONE, h)
    if len(masked) <= tau:
        return np.zeros(0, np.int64)
    least = sliding_least(masked, tau + 1)
    n = len(least)
    return np.flatnonzero((least != _NONE) & ((masked[:n] == least) | (masked[tau:tau + n] == least)))


def ahead(w: np.ndarray, i: int, p: int) -> int:
    """The first position from i on whose word differs from the one p places on."""
    size = 64
    while True:
        b = w[i + p:i + p + size]
        differ = np.flatnonzero(w[i:i + len(b)] != b)
        if len(differ):
            return i + int(differ[0])
        if len(b) < size:
            return i + len(b)
        i, size = i + size, size * 2


def behind(w: np.ndarray, i: int, p: int) -> int:
    """The least start from which all positions before i equal the ones p places on."""
    size = 64
    while i > 0:
        a = max(0, i - size)
        differ = np.flatnonzero(w[a:i] != w[a + p:i + p])
        if len(differ):
            return a + int(differ[-1]) + 1
        i, size = a, size * 2
    return 0


def find_runs(w: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs of a sequence of word hashes, no
    run longer than ``longest`` words."""
    found = small_periods(w, min(DIRECT, longest // EXPONENT))
    h, size = w, 1
    while size < DIRECT and len(h) > size:
        h, size = joined(h, size), size * 2
    tau = size                          # scale c = 2 * tau: periods in (tau, 2 * tau]
    while tau >= DIRECT and EXPONENT * (tau + 1) <= longest and len(h) > tau:
        context = joined(h, tau)
        at = synchronising(h, tau, found)
        at = at[at < len(context)]
        key = context[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        p = at[1:] - at[:-1]
        pick = (key[1:] == key[:-1]) & (p > tau) & (p <= 2 * tau)
        at, p = at[:-1][pick], p[pick]
        order = np.argsort(at, kind="stable")
        done: dict[int, int] = {}       # period -> end of the last stretch looked at
        for i, q in zip(at[order].tolist(), p[order].tolist()):
            if i + q < done.get(q, 0):
                continue
            e, s = ahead(w, i, q) + q, behind(w, i, q)
            done[q] = e
            if e - s >= max(LEAST, EXPONENT * q):
                found.append((s, e, q))
        h, tau = context, tau * 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(words: np.ndarray, count: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every text; ``words``: the hashes of
    all texts' words, ``count`` of each."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in count]
    first = np.cumsum(count) - count
    kind = np.frexp(np.maximum(count, 1))[1]
    for k in np.unique(kind[count >= LEAST]).tolist():
        rows = np.flatnonzero((kind == k) & (count >= LEAST))
        n = count[rows]
        begin = np.cumsum(n + 1) - n - 1            # one word of its own after each text
        w = mix64(np.arange(1, int((n + 1).sum()) + 1, dtype=np.uint64) * MIX_B)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        w[np.repeat(begin, n) + within] = words[np.repeat(first[rows], n) + within]
        for s, e, p in find_runs(w, int(n.max())):
            r = int(np.searchsorted(begin, s, side="right")) - 1
            out[rows[r]].append((s - int(begin[r]), e - s, p))
    return out


def collapsed(data: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray,
              drop: np.ndarray) -> pa.Array:
    """The words that stay, joined by single spaces, of every row."""
    s, e, row = s[~drop], e[~drop], row[~drop]
    keep = np.zeros(len(data) + 1, np.int64)
    keep[s] += 1
    keep[e] -= 1
    keep = np.cumsum(keep)[:-1] > 0
    # The byte after a word is a separator if another word of the row follows.
    gap = e[:-1][row[1:] == row[:-1]]
    data = data.copy()
    data[gap] = 32
    keep[gap] = True
    stop = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(stop.astype(np.int64)),
                                            pa.py_buffer(data[keep])).cast(pa.string())


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: the runs by start,
    then period, and the text's words without those that any run contains
    after its first period, joined by single spaces."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def find(batches):
        for rb in batches:
            data, offsets = text_bytes(rb.column("text"))
            s, e, row = runs(~SPACE[data], offsets)
            count = np.bincount(row, minlength=len(offsets) - 1)
            first = np.cumsum(count) - count
            per_text = text_runs(run_hashes(data, s, e), count)
            gone = np.zeros(len(s) + 1, np.int64)
            for f, found in zip(first.tolist(), per_text):
                for start, length, period in found:
                    gone[f + start + period] += 1
                    gone[f + start + length] -= 1
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(per_text, RUNS),
                 collapsed(data, offsets, s, e, row, np.cumsum(gone)[:-1] > 0)],
                ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, n_words LONG, "
                                 "runs ARRAY<STRUCT<start: LONG, length: LONG, period: LONG>>, collapsed STRING")
