"""N-gram Jaccard join by prefix filters under several token orders.

Two sets whose Jaccard similarity reaches the threshold share a token among
the first ``n - ceil(t * n) + 1`` tokens of each, under *every* order of all
tokens.  Candidates come from a join on the prefix tokens of the first
order; the overlap that a pair needs grows with both sizes, so of the smaller
set only the first ``n - ceil(2t / (1 + t) * n) + 1`` tokens count.  Their sizes, and counts of their tokens by a few bits of the hash,
bound the similarity from above and leave out most of them.  The others stay
only if they also share prefix tokens under the other orders, and what is left
is verified on the whole sets.  Every order puts tokens
that are frequent (a bounded table, counted over all documents) last, so
common lines make no candidates.  An order is a fixed function of the token:
however rough the counts are, no link is lost.

Groups of copies: documents with equal sets become one node first.  Every
prefix token has a few leaders among its nodes, and a node is compared with at
most ``LEADERS`` leaders of its tokens (linear in the group); the links merge
components.  Only what is then left, nodes of *different* components that share
a prefix token, is compared, within the join on the token: every node has a
bitmap of its whole set, and only pairs that two bitmaps leave possible become
rows.  A bit that one set has and the other lacks is a token that only one has,
so no link is lost, and of the pairs below the threshold few are left.  The
components are those of all links, but a large group of near copies never
becomes all its pairs.

Sets hold 64-bit hashes of shingles, and a node is the 64-bit hash of a set.

Defined cases: a text that is null or has no word has an empty set and
links with nothing; a shorter text than a shingle is one shingle; repeated
rows get equal results; a null doc_id is never a component's id unless all
its rows have none; an empty table gives an empty table.  Only ``doc_id``
and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.functions import arrow_udf

from lectern.llm.common import (SPACE, bounded_batches, components, discard, materialize, mix64, process_cache,
                                release, run_hashes, runs, text_bytes)

WORDS = 4
PERCENT = 85
ORDERS = 3
LEADERS = 32             # leaders that a node is compared with
SHARES = 8               # leaders of a token, besides its best one
HOT_TOKENS = 1 << 19     # frequent tokens that the orders put last (8 bytes each)
HOT_IN_CHUNK = 2         # documents of a chunk that make a token worth counting
HOT_AT_LEAST = 6
CHUNK_TOKENS = 1 << 22   # tokens counted at once in a task
CELLS = 1 << 13          # counts of a sketch at most
BITS = 1 << 10           # bits of a set's bitmap (128 bytes), the same for every set

_PLACE = mix64(np.arange(11, 43, dtype=np.uint64))
_ORDER = mix64(np.arange(101, 133, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    s, e, row = runs(~SPACE[data], offsets)
    w = run_hashes(data, s, e, lower=True)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    if len(w) >= words:
        k = len(w) - words + 1
        h = np.zeros(k, np.uint64)
        for j in range(words):
            h += w[j:j + k] * _PLACE[j]
        h = mix64(h)
    out = []
    for f, m in zip(first.tolist(), n.tolist()):
        if m >= words:
            out.append(np.unique(h[f:f + m - words + 1]))
        elif m:
            out.append(mix64(np.array([np.add.reduce(w[f:f + m] * _PLACE[:m]) ^ np.uint64(m)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(x: np.ndarray) -> int:
    """Hash of a set that does not depend on the order of its members."""
    return int(mix64(np.array([np.add.reduce(mix64(x ^ _ORDER[-1])) + np.uint64(len(x))], np.uint64)).view(np.int64)[0])


def lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Prefix lengths of a set of n tokens: towards sets of any size, and
    towards sets that are not smaller (the overlap is then at least
    2t / (1 + t) of n)."""
    return n + (-percent * n) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1


def prefix(x: np.ndarray, order: int, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The tokens that come first under an order, in that order: rare ones
    by a hash of the order's own, then frequent ones."""
    p = lengths(len(x), percent)[0]
    key = mix64(x ^ _ORDER[order]) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
        key |= (hot[at] == x).astype(np.uint64) << np.uint64(63)
    first = np.argpartition(key, p - 1)[:p] if p < len(x) else np.arange(len(x))
    return x[first[np.argsort(key[first])]]


def sketch(x: np.ndarray) -> bytes:
    """How many tokens begin with each bit pattern, about 8 patterns' worth
    of tokens each; empty where a count does not fit a byte."""
    cells = int(np.clip(1 << max(0, int(len(x)).bit_length() - 3), 16, CELLS))
    shift = np.uint64(64 - (cells.bit_length() - 1))
    c = np.bincount((x >> shift).astype(np.int64), minlength=cells)
    return c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b""


def at_most(a: bytes, b: bytes) -> int:
    """Upper bound of the size of the intersection (-1: none known)."""
    if not a or not b:
        return -1
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum())


def bitmap(x: np.ndarray) -> np.ndarray:
    """One bit for each token: those of two sets differ in at most as many
    bits as the sets differ in tokens."""
    inside = np.zeros(BITS, dtype=bool)
    inside[(mix64(x ^ _ORDER[-2]) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(inside).view(np.uint64)


def may_link(a: str, b: str, percent: int = PERCENT) -> str:
    """SQL: sizes and bitmaps of two sets do not rule their similarity out.  The
    overlap is at most half of what the sizes leave after the bits that differ."""
    differ = f"aggregate(zip_with({a}.bits, {b}.bits, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    return f"(100 + {percent}) * {differ} <= (100 - {percent}) * ({a}.n + {b}.n)"


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    stop = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(flat.view(np.int64)))


def frequent_tokens(docs: DataFrame, words: int = WORDS, limit: int = HOT_TOKENS) -> np.ndarray:
    """Tokens that many documents have, at most ``limit``.  Every chunk of
    every partition is counted; a chunk reports tokens that recur in it."""
    def count(batches):
        process_cache("ngram")
        kept, size = [], 0

        def counted():
            tok, c = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            keep = c >= HOT_IN_CHUNK
            return pa.RecordBatch.from_arrays([pa.array(tok[keep].view(np.int64)), pa.array(c[keep])], ["token", "c"])

        for rb in batches:
            data, offsets = text_bytes(rb.column("text"))
            sets = shingle_sets(data, offsets, words)
            kept += sets
            size += sum(map(len, sets))
            if size > CHUNK_TOKENS:
                yield counted()
                size = 0
        if kept:
            yield counted()
        release()

    top = (docs.select("text").mapInArrow(count, "token LONG, c LONG").groupBy("token").agg(F.sum("c").alias("c"))
           .filter(F.col("c") >= HOT_AT_LEAST).orderBy(F.desc("c"), "token").limit(limit).select("token").toPandas())
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS,
         scratch: list | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.
    ``scratch`` is given the tables that the result still reads: a caller that
    has written it can discard them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = spark.sparkContext.broadcast(frequent_tokens(docs, words))   # at most HOT_TOKENS * 8 bytes

    def signatures(batches):
        for rb in batches:
            data, offsets = text_bytes(rb.column("text"))
            sets = shingle_sets(data, offsets, words)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"),
                 pa.array([set_hash(x) if len(x) else None for x in sets], pa.int64()),
                 pa.array([len(x) for x in sets], pa.int64()),
                 _longs([prefix(x, 0, hot.value, percent) if len(x) else x for x in sets]),
                 pa.array([sketch(x) for x in sets], pa.binary()), _longs([bitmap(x) for x in sets])],
                ["doc_id", "nid", "n", "prefix", "sketch", "bits"])
        release()

    signed = materialize(docs.mapInArrow(signatures, "doc_id LONG, nid LONG, n LONG, prefix ARRAY<LONG>, sketch BINARY, bits ARRAY<LONG>"),
                         "signatures")
    nodes = materialize(signed.filter("n > 0").groupBy("nid").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
        F.first("sketch").alias("sketch"), F.first("bits").alias("bits")), "nodes")

    # Tokens that several nodes have in their prefixes, with the smallest node.
    # ``early``: the token counts towards sets that are not smaller.  Without
    # an early node the nodes of a token cannot meet.
    rows = nodes.select("nid", "n", F.posexplode("prefix").alias("at", "token")).select(
        "nid", "n", "token", (F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1).alias("early"))
    shared = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max("early").alias("any"))
                         .filter("c > 1 AND any").select("token"), "tokens")
    groups = materialize(rows.join(shared, "token"), "groups")
    discard(shared)
    # Share of a node's prefix that others have: of a group of near copies,
    # one with few edits of its own makes a good leader.
    common = groups.groupBy("nid").agg((-F.count(F.lit(1)) / F.max("n")).alias("own"))
    led = materialize(groups.join(common, "nid"), "led")
    discard(groups)
    meet = (f"100 * least({{a}}.n, {{b}}.n) >= {percent} * greatest({{a}}.n, {{b}}.n)"
            " AND ({a}.early OR {a}.n > {b}.n) AND ({b}.early OR {b}.n > {a}.n)")

    def leaders(placed: DataFrame) -> DataFrame:
        """Pairs of a node and leaders of its tokens.  A token has several:
        its best one, and the first of each share of its nodes."""
        rank = lambda r: F.struct((~F.col("early")).alias("late"), r.alias("rank"), "nid", "n")
        share = F.pmod(F.xxhash64("nid"), F.lit(SHARES))
        found = placed.groupBy("token", share.alias("share")).agg(
            F.min(rank(F.col("own"))).alias("central"), F.min(rank(F.xxhash64("nid", "token") / F.lit(2.0 ** 63))).alias("some"))
        lead = found.groupBy("token").agg(F.min("central").alias("central"), F.collect_list("some").alias("others")).select(
            "token", F.explode(F.array_distinct(F.concat(F.array("central"), "others"))).alias("lead"))
        pairs = (placed.join(lead, "token").filter("nid <> lead.nid")
                 .select(F.struct("nid", "n", "early").alias("x"), F.struct(
                     "lead.nid", "lead.n", (~F.col("lead.late")).alias("early")).alias("y"), F.col("lead.rank").alias("rank"))
                 .filter(meet.format(a="x", b="y"))
                 .groupBy(F.col("x.nid").alias("nid"), F.col("y.nid").alias("lead")).agg(F.min("rank").alias("rank")))
        first = Window.partitionBy("nid").orderBy("rank", "lead")       # at most SHARES + 1 rows for each prefix token
        return (pairs.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= LEADERS)
                .select(F.least("nid", "lead").alias("a"), F.greatest("nid", "lead").alias("b")).distinct())

    @arrow_udf("boolean")
    def possible(a_sketch: pa.Array, b_sketch: pa.Array, both: pa.Array) -> pa.Array:
        bound = [at_most(x, y) for x, y in zip(a_sketch.to_pylist(), b_sketch.to_pylist())]
        return pa.array([i < 0 or 100 * i >= percent * (n - i) for i, n in zip(bound, both.to_pylist())], pa.bool_())

    def plausible(pairs: DataFrame) -> DataFrame:
        side = lambda s: nodes.select(F.col("nid").alias(s), F.struct("n", "bits").alias(f"_{s}"), F.col("sketch").alias(f"{s}_s"))
        near = (pairs.join(side("a"), "a").join(side("b"), "b")
                .filter(f"100 * least(_a.n, _b.n) >= {percent} * greatest(_a.n, _b.n) AND " + may_link("_a", "_b", percent)))
        return materialize(near.filter(possible("a_s", "b_s", F.col("_a.n") + F.col("_b.n"))).select("a", "b"), "plausible")

    def whole(batches):
        for rb in batches:
            data, offsets = text_bytes(rb.column("text"))
            sets = shingle_sets(data, offsets, words)
            want = rb.column("want").to_numpy()
            keep = [i for i, x in enumerate(sets) if len(x) and set_hash(x) == want[i]]
            sets = [sets[i] for i in keep]
            later = [_longs([prefix(x, o, hot.value, percent) for x in sets]) for o in range(1, orders)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(want[keep], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), _longs(sets), *later],
                ["nid", "n", "tokens", *[f"p{o}" for o in range(1, orders)]])
        release()

    schema = "nid LONG, n LONG, tokens ARRAY<LONG>" + "".join(f", p{o} ARRAY<LONG>" for o in range(1, orders))

    def token_sets(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Whole sets, and prefixes under the later orders, of the nodes of pairs."""
        nids = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
        if known is not None:
            nids = nids.join(known, "nid", "left_anti")
        reps = nodes.join(nids, "nid", "left_semi").select("rep", F.col("nid").alias("want"))
        return materialize(docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep"])).select("text", "want")
                           .mapInArrow(whole, schema).dropDuplicates(["nid"]), "sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        more = [f"p{o}" for o in range(1, orders)]
        side = lambda s, cols: sets.select(F.col("nid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])
        test = F.lit(True)
        for p in more:
            test &= F.arrays_overlap(f"a_{p}", f"b_{p}")
        left = materialize(pairs.join(side("a", more), "a").join(side("b", more), "b")
                           .filter(test).select("a", "b"), "candidates")
        both = left.join(side("a", ["n", "tokens"]), "a").join(side("b", ["n", "tokens"]), "b")
        i = F.size(F.array_intersect("a_tokens", "b_tokens"))
        out = materialize(both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("s"), i.alias("i"))
                          .filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"), "links")
        discard(left)
        return out

    star = plausible(leaders(led))
    sets = token_sets(star)
    links = verified(star, sets)
    comp = components(links)
    # Nodes of different components that share a prefix token.
    placed = materialize(led.join(comp, led["nid"] == comp["node"], "left").select(
        "token", "nid", "n", "early", F.coalesce("component", "nid").alias("comp")), "placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rest = placed.join(mixed, "token").join(nodes.select("nid", "bits"), "nid")
    cross = (rest.alias("x").join(rest.alias("y"), "token")
             .filter("x.nid < y.nid AND x.comp <> y.comp AND " + meet.format(a="x", b="y") + " AND " + may_link("x", "y", percent))
             .select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b")).distinct())
    cross = plausible(cross)
    discard(led, placed, star)
    if cross.take(1):
        more = token_sets(cross, sets)
        late = verified(cross, sets.unionByName(more))
        discard(more, comp)
        comp = components(links.union(late))
    discard(sets, cross)

    if scratch is not None:
        scratch += [signed, nodes, links, comp]
    named = nodes.select("nid", "rep").join(comp, F.col("nid") == F.col("node"), "left").select(
        "nid", "rep", F.coalesce("component", "nid").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = named.select("nid", "comp").join(ids, "comp").select(F.col("nid").alias("_nid"), "component_id")
    return (signed.select("doc_id", "nid", "n").join(of, F.col("nid") == F.col("_nid"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """One row of every group: the one that names the component.  Rows that
    share their doc_id (or have none) but not their text all stay."""
    keep = joined.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return (docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
            .withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text"))
