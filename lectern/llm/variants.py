"""Spelling variants: words one edit apart, each under its most frequent neighbour.

Two words are *near* if one inserted, deleted or replaced code point turns
one into the other.  Such words have almost the same letters: the L1 distance
of their letter counts is one for an insertion and two for a replacement.  So
near words are found by range searches in k-d trees over the letter counts,
one tree for each word length: words of length n are looked for in the tree of
length n within distance two, and in that of length n + 1 within distance one.
A query goes down both sides of a split while the boxes there are near enough;
what the boxes leave is compared by bit patterns of the counts and then letter
by letter.

* The upper splits of a long length's tree come from a bounded sample of its
  words (``SAMPLE``, all lengths together) and are broadcast.  They only decide
  which words meet in a task: every word is a point of one leaf and a query of
  every leaf within its distance.
* Leaves with more words than ``BLOCK`` are searched in blocks of points and
  queries, so no task holds more of one leaf, whatever the sample saw.
* A task builds the lower part of the tree over its points, and reports for
  each word how many near words it found and the most frequent one, never
  the pairs.

Roots are found by pointer jumping: every round doubles the steps, and as
counts at least double along the way, six rounds reach any root.

Defined cases: null and empty texts have no words; a null word is left out;
words of any length take part, also such with letters that the counts do not
tell apart; an empty table gives an empty table; only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, discard, materialize, release

MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2               # a form occurs this many times as often as its word at least
SAMPLE = 1 << 16        # words that the upper splits are fitted on, about
LEAF = 16384            # words of a leaf of the upper tree, about
BLOCK = 32768           # points, and queries, of a leaf that one task takes
BUCKET = 16             # points of a leaf of the lower tree
KEPT_WORDS = 400_000    # words that a task counts before it passes them on

WORD = re.compile("[a-zÀ-ÿ]+")
LETTERS = 26 + 64       # a-z, U+00C0 to U+00FF
FAR = 1 << 30


# ------------------------------------------------------------- counting

def count_words(docs: DataFrame, rewrite: Callable | None = None, min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the runs of letters (A-Z lower-cased) of all texts that
    have ``min_letters`` code points and occur ``min_count`` times at least.
    ``rewrite(doc_id, words)`` may put others in the place of a document's
    distinct words before they are counted."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        kept: dict[str, int] = {}

        def passed_on():
            yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())],
                                             ["word", "n"])
            kept.clear()

        for rb in batches:
            for doc_id, text in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()):
                if not text:
                    continue
                found = Counter(WORD.findall(text.encode().lower().decode()))
                words = rewrite(doc_id, list(found)) if rewrite else found
                for word, n in zip(words, found.values()):
                    if len(word) >= min_letters:
                        kept[word] = kept.get(word, 0) + n
            if len(kept) > KEPT_WORDS:
                yield from passed_on()
        yield from passed_on()
        release()

    return (docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, "word STRING, n LONG")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# ---------------------------------------------------------------- trees

def code_points(words: list[str], length: int) -> np.ndarray:
    """(words, length) code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """(words, LETTERS) counts; other code points share the letters' places."""
    place = np.where(codes < 0xC0, (codes - 97) % 26, 26 + (codes - 0xC0) % 64).astype(np.int64)
    flat = place + LETTERS * np.arange(len(codes))[:, None]
    return np.bincount(flat.ravel(), minlength=LETTERS * len(codes)).reshape(-1, LETTERS).astype(np.int32)


def bits(counts: np.ndarray) -> np.ndarray:
    """Two words of bits for each vector; the bits that differ bound the L1
    distance from below."""
    one = (counts >= 1).astype(np.uint64)
    two = (counts[:, :26] >= 2).astype(np.uint64)
    low = np.concatenate([one[:, :26], two], axis=1) << np.arange(52, dtype=np.uint64)
    high = one[:, 26:] << np.arange(64, dtype=np.uint64)
    return np.stack([low.sum(axis=1, dtype=np.uint64), high.sum(axis=1, dtype=np.uint64)], axis=1)


PARTS = ("dim", "cut", "left", "lo", "hi", "a_lo", "a_hi", "b_lo", "b_hi", "root_lo", "root_hi")


def outside(x, lo, hi):
    return np.maximum(np.maximum(lo - x, x - hi), 0)


class Tree:
    """K-d tree over count vectors.  Node i splits by letter ``dim``: up to
    ``cut`` to node ``left``, above it to the next one; a leaf has ``dim`` -1
    and its number in ``cut``.  ``lo`` and ``hi`` bound that letter before the
    split, ``a_`` and ``b_`` behind it.  Boxes are as small as the vectors
    allow, or (``open_``) hold whatever vector goes down that way."""

    def __init__(self, vectors: np.ndarray | None, leaf: int = BUCKET, open_: bool = False,
                 parts: list[np.ndarray] | None = None):
        if parts is not None:           # of another tree, without its members
            for name, values in zip(PARTS, parts):
                setattr(self, name, values)
            return
        self.members: list[np.ndarray] = []
        nodes: list[list[int]] = [[-1] * 9]
        self.root_lo = np.full(LETTERS, -FAR) if open_ or not len(vectors) else vectors.min(axis=0).astype(np.int64)
        self.root_hi = np.full(LETTERS, FAR) if open_ or not len(vectors) else vectors.max(axis=0).astype(np.int64)
        todo = [(0, np.arange(len(vectors)), {})]
        while todo:
            i, rows, box = todo.pop()
            d = -1
            if len(rows) > leaf:
                v = vectors[rows]
                low, high = v.min(axis=0), v.max(axis=0)
                spread = np.where(high > low, v.var(axis=0), -1.0)
                d = int(spread.argmax())
                d = d if spread[d] >= 0 else -1             # -1: all alike
            if d < 0:
                nodes[i][1] = len(self.members)
                self.members.append(rows)
                continue
            x = v[:, d]
            cut = min(int(np.median(x)), int(high[d]) - 1)
            below = x <= cut
            lo, hi = box.get(d, (int(self.root_lo[d]), int(self.root_hi[d])))
            a = (lo, cut) if open_ else (int(low[d]), int(x[below].max()))
            b = (cut + 1, hi) if open_ else (int(x[~below].min()), int(high[d]))
            nodes[i] = [d, cut, len(nodes), lo, hi, *a, *b]
            todo.append((len(nodes), rows[below], {**box, d: a}))
            todo.append((len(nodes) + 1, rows[~below], {**box, d: b}))
            nodes += [[-1] * 9, [-1] * 9]
        for name, column in zip(PARTS, np.array(nodes, dtype=np.int64).T):
            setattr(self, name, np.ascontiguousarray(column))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in PARTS]

    def reach(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose box is within ``radius``."""
        left = radius - outside(queries, self.root_lo, self.root_hi).sum(axis=1)
        q = np.flatnonzero(left >= 0)
        left, node = left[q], np.zeros(len(q), np.int64)
        found = [(q[:0], q[:0])]
        while len(q):
            leaf = self.dim[node] < 0
            found.append((q[leaf], self.cut[node[leaf]]))
            q, node, left = q[~leaf], node[~leaf], left[~leaf]
            x = queries[q, self.dim[node]].astype(np.int64)
            left = left + outside(x, self.lo[node], self.hi[node])
            below = left - outside(x, self.a_lo[node], self.a_hi[node])
            above = left - outside(x, self.b_lo[node], self.b_hi[node])
            a, b = below >= 0, above >= 0
            q, node, left = (np.concatenate(z) for z in ((q[a], q[b]), (self.left[node[a]], self.left[node[b]] + 1),
                                                         (below[a], above[b])))
        return tuple(np.concatenate(z) for z in zip(*found))


# --------------------------------------------------------------- search

def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a word of ``b`` is the word of ``a`` with one code point more."""
    n = a.shape[1]
    same = a == b[:, :n]
    head = np.where(same.all(axis=1), n, np.argmin(same, axis=1))
    same = (a == b[:, 1:])[:, ::-1]
    tail = np.where(same.all(axis=1), n, np.argmin(same, axis=1))
    return head + tail >= n


def near_pairs(tree: Tree, points: np.ndarray, point_bits: np.ndarray, queries: np.ndarray, radius: int):
    """Chunks of (query, point) whose code points are one edit apart."""
    same = queries.shape[1] == points.shape[1]
    size = np.array([len(m) for m in tree.members])
    first = np.cumsum(size) - size
    member = np.concatenate(tree.members)
    for at in range(0, len(queries), 512):
        part = queries[at:at + 512]
        counts = letter_counts(part)
        own = bits(counts)
        q, leaf = tree.reach(counts, radius)
        n = size[leaf]
        p = member[np.repeat(first[leaf] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        q = np.repeat(q, n)
        close = np.bitwise_count(own[q] ^ point_bits[p]).sum(axis=1, dtype=np.int64) <= radius
        q, p = q[close], p[close]
        step = max(1, (1 << 22) // points.shape[1])
        for i in range(0, len(q), step):
            a, b = q[i:i + step], p[i:i + step]
            ok = (one_replaced if same else one_inserted)(part[a], points[b])
            if ok.any():
                yield a[ok] + at, b[ok]


FOUND = "word STRING, n_near LONG, best_n LONG, best STRING"


def _best(words: list[str], other: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """For every word ``a``: its pairs, and its most frequent partner ``b``
    (ties: first in code-point order)."""
    rank = np.empty(len(other), np.int64)
    rank[np.array(sorted(range(len(other)), key=other.__getitem__), dtype=np.int64)] = np.arange(len(other))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return pa.table({"word": pa.array([words[i] for i in a[head].tolist()], pa.string()),
                     "n_near": pa.array(np.diff(np.append(head, len(a))), pa.int64()),
                     "best_n": pa.array(n[b[head]], pa.int64()),
                     "best": pa.array([other[i] for i in b[head].tolist()], pa.string())})


def search_leaf(rows: pa.Table) -> pa.Table:
    """Near words among the points (role 0) of a block and its queries of the
    same length (1) or one code point shorter (2)."""
    role = rows.column("role").to_numpy()
    sides = []
    for r in (0, 1, 2):
        mine = rows.filter(pa.array(role == r))
        sides.append((mine.column("word").to_pylist(), mine.column("n").to_numpy()))
    (points, pn), out = sides[0], []
    length = len(points[0]) if points else 0
    if points and (sides[1][0] or sides[2][0]):
        codes = code_points(points, length)
        counts = letter_counts(codes)
        tree, marks = Tree(counts, BUCKET), bits(counts)
        for (words, n), shorter in ((sides[1], 0), (sides[2], 1)):
            if not words:
                continue
            found = list(near_pairs(tree, codes, marks, code_points(words, length - shorter), 2 - shorter))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                out.append(_best(words, points, pn, a, b))
                if shorter:         # the longer words are no queries for shorter ones
                    out.append(_best(points, words, n, b, a))
    release()
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()),
                      "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    return pa.concat_tables(out) if out else empty


def upper_trees(words: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> dict[int, Tree]:
    """Trees of the lengths with more than ``leaf`` words, fitted on about
    ``sample`` words, the ones whose hash falls in a share of all hashes."""
    sizes = words.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    long = {r["k"]: r["n"] for r in sizes.filter(F.col("n") > leaf).collect()}
    total = sum(long.values())
    if not total:
        return {}
    share = max(1, -(-total // sample))

    def counted(batches):
        for rb in batches:
            got = [w for w in rb.column("word").to_pylist() if len(w) in long]
            vectors = [letter_counts(code_points([w], len(w)))[0].astype(np.int32).tobytes() for w in got]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in got], pa.int32()), pa.array(vectors, pa.binary())],
                                             ["k", "v"])

    rows = (words.filter(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word")
            .mapInArrow(counted, "k INT, v BINARY").toPandas())
    out = {}
    for k, mine in rows.sort_values(["k", "v"]).groupby("k"):
        vectors = np.frombuffer(b"".join(mine["v"]), np.int32).reshape(-1, LETTERS)
        leaves = -(-long[k] // leaf)
        out[int(k)] = Tree(vectors, max(8, len(vectors) // leaves), open_=True)
    return out


def near_words(words: DataFrame, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have a near word."""
    spark = words.sparkSession
    # The splits of trees over about SAMPLE words.
    upper = spark.sparkContext.broadcast({k: tree.parts() for k, tree in upper_trees(words, leaf, sample).items()})

    def deal(batches):
        trees = {k: Tree(None, parts=parts) for k, parts in upper.value.items()}
        for rb in batches:
            got = rb.column("word").to_pylist()
            length = np.array([len(w) for w in got], dtype=np.int64)
            rows: list[tuple[np.ndarray, ...]] = []
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                counts = letter_counts(code_points([got[i] for i in at.tolist()], k))
                for role, length_of, radius in ((0, k, 0), (1, k, 2), (2, k + 1, 1)):
                    tree = trees.get(length_of)
                    q, to = tree.reach(counts, radius) if tree else (np.arange(len(at)), np.zeros(len(at), np.int64))
                    rows.append((at[q], np.full(len(q), length_of), to, np.full(len(q), role)))
            at, k, to, role = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(
                [rb.column("word").take(pa.array(at)), rb.column("n").take(pa.array(at)), pa.array(k), pa.array(to),
                 pa.array(role.astype(np.int32))], ["word", "n", "k", "leaf", "role"])

    dealt = materialize(words.select("word", "n").mapInArrow(
        deal, "word STRING, n LONG, k LONG, leaf LONG, role INT"), "dealt-words")
    # Blocks of points and of queries of a leaf; most leaves are one block.
    of = (dealt.groupBy("k", "leaf").agg(F.count(F.when(F.col("role") == 0, 1)).alias("points"),
                                         F.count(F.when(F.col("role") > 0, 1)).alias("queries"))
          .filter("points > 0 AND queries > 0")
          .select("k", "leaf", F.ceil(F.col("points") / block).cast("int").alias("ps"),
                  F.ceil(F.col("queries") / block).cast("int").alias("qs")))
    own = F.pmod(F.xxhash64("word"), F.when(F.col("role") == 0, F.col("ps")).otherwise(F.col("qs"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("qs")).otherwise(F.col("ps")) - 1))
    blocks = (dealt.join(of, ["k", "leaf"]).select("k", "leaf", "role", "word", "n", own.alias("own"), others.alias("other"))
              .withColumn("pb", F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")))
              .withColumn("qb", F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))))
    found = materialize(blocks.groupBy("k", "leaf", "pb", "qb").applyInArrow(
        lambda t: search_leaf(t.select(["role", "word", "n"])), FOUND), "near-words")
    discard(dealt)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def group(words: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of distinct words
    with their counts ``n``."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL"), "words")
    near = near_words(words, **options)
    fits = F.col("best_n") >= ratio * F.col("n")
    named = materialize(words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best_n")).alias("form_n")), "named-words")
    roots = materialize(named.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = materialize(roots.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = bool(nxt.filter("moved").take(1))
        discard(roots)
        roots = nxt.drop("moved")
        if not moved:
            break
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                    "n", "n_near", "form_n")
