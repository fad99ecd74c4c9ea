"""Removal of repeated byte strings by difference-cover suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts
anywhere else, in the same document or another.  Suffix-sorting every byte of
a corpus would move it many times over, so the work is cut down first,
without losing a match:

1. Every string of LENGTH bytes has an *anchor*: of its ``KERNEL``-byte
   substrings the leftmost one with the least hash.  Equal strings have equal
   anchors at equal places, so strings can only match within one anchor hash.
   Consecutive strings with one anchor form a *run* (its text: from the first
   string's begin to the last one's end); there is one for about 170 bytes.
2. Runs with equal texts are copies: all their strings are repeated, and one
   of them stands for all in what follows.  Anchors with a single run text
   have no match.
3. What is left, run texts that occur once but share their anchor with
   others (around edits and at the ends of shared passages), is dealt out by
   anchor hash, and each bucket is suffix-sorted by the difference-cover
   algorithm modulo 3: sort the triples at sampled positions, recurse on
   their names, sort the rest by their first symbol and the sample's ranks,
   merge.  Strings next to each other in suffix order are compared.

An anchor with more run texts than a bucket may hold is finished by hashes
of its strings, aggregated by Spark; so no task holds an unbounded group.
Texts are compared by 64-bit polynomial hashes.

Defined cases: a null text is empty; texts shorter than LENGTH keep all
bytes; repeated rows are documents of their own (and match each other);
very long texts are worked through in pieces of a megabyte; an empty table
gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import _BASE, _BYTE, bounded_batches, materialize, mix64, powers, text_bytes

LENGTH = 400
KERNEL = 64
PIECE = 1 << 20          # bytes worked on at once
BUCKET_BYTES = 1 << 20   # run texts of a bucket, about
GROUP_TEXTS = 1024       # run texts of one anchor that a bucket may hold

_INVERSE = pow(_BASE, -1, 1 << 64)
_POS = np.uint64((1 << 21) - 1)


# ------------------------------------------------------------ hashing

class Hashes:
    """Polynomial prefix sums of a byte string."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(n, _BASE)[:n], out=self.total[1:])
        self.back = powers(n, _INVERSE)

    def of(self, start, end) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.back[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, kernel: int):
    """Runs of string starts with one anchor: first and last start, anchor
    hash, hash of the run's text."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h = Hashes(data)
    at = np.arange(n - kernel + 1)
    value = h.of(at, at + kernel)
    # Hash first, then place: the least is the leftmost one of the least hash.
    least = sliding_least((value & ~_POS) | at.astype(np.uint64), length - kernel + 1)
    anchor = (least & _POS).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    head[offsets[long]] = True
    first = np.flatnonzero(head)
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | head[1:]
    last = np.flatnonzero(tail)
    return first, last, value[anchor[first]], h.of(first, last + length)


# ------------------------------------------------------ suffix sorting

def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of ``s`` (symbols 1 .. symbols - 1) by the difference
    cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # One more sampled suffix where the text's length leaves the last third alone.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (t[sample] * symbols + t[sample + 1]) * symbols + t[sample + 2]
    different, names = np.unique(triples, return_inverse=True)
    if len(different) < len(sample):
        order = suffix_array(names + 1, len(different) + 1)
    else:
        order = np.argsort(names)
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    top = len(sample) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * top + rank[rest + 1], kind="stable")]
    sorted_sample = sorted_sample[sorted_sample < n]
    # Merge: how many sampled suffixes of either kind come before each other one.
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    by_one = lambda i: t[i] * top + rank[i + 1]
    by_two = lambda i: (t[i] * symbols + t[i + 1]) * top + rank[i + 2]
    place = np.arange(len(rest)) + np.searchsorted(by_one(one), by_one(rest)) + np.searchsorted(by_two(two), by_two(rest))
    out = np.zeros(n, np.int64)
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place] = rest
    out[free] = sorted_sample
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of strings of ``length`` bytes that start
    somewhere else too, in any of the texts."""
    blob = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
    # Symbol 1 stands between texts; strings never reach over it.
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    s = blob.astype(np.int64) + 2
    s[begin[1:] - 1] = 1
    valid = np.zeros(len(s) + 1, np.int64)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + np.maximum(sizes - length + 1, 0), -1)
    valid = np.cumsum(valid)[:-1] > 0
    order = suffix_array(s, 258)
    order = order[valid[order]]
    h = Hashes(blob)
    key = h.of(order, order + length)
    same = key[1:] == key[:-1]
    again = np.zeros(len(s), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return [np.flatnonzero(again[b:b + n]) for b, n in zip(begin.tolist(), sizes.tolist())]


def spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the bytes that consecutive string starts cover."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length


# ---------------------------------------------------------------- Spark

def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(bytes, offsets, rows, place of the first byte in its row) of whole
    rows up to PIECE bytes, or of a piece of a long row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > PIECE:
            size = int(offsets[i + 1] - offsets[i])
            for p in range(0, size - length + 1, PIECE):
                part = data[offsets[i] + p:offsets[i] + min(size, p + PIECE + length - 1)]
                yield part, np.array([0, len(part)]), np.array([i]), p
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        yield data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], np.arange(i, j), 0
        i = j


RUN = "anchor LONG, text_hash LONG, size INT, copies LONG, rid LONG, first LONG"
SPAN = "rid LONG, s LONG, e LONG"


def covered(docs: DataFrame, length: int = LENGTH, kernel: int = KERNEL, group_texts: int = GROUP_TEXTS,
            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (rid, text) -> ``rid, s, e``: byte ranges that repeated strings cover."""

    def find(batches):
        for rb in batches:
            data, offsets = text_bytes(rb.column("text"))
            rids = rb.column("rid").to_numpy()
            for part, offs, rows, place in _pieces(data, offsets, length):
                first, last, anchor, text = anchor_runs(part, offs, length, kernel)
                if not len(first):
                    continue
                at = np.searchsorted(offs, first, side="right") - 1
                rid, p = rids[rows[at]], first - offs[at] + place
                size = (last - first + 1).astype(np.int32)
                # Copies inside the piece: repeated for certain, and one row stands for them.
                _, where, back, n = np.unique(anchor ^ mix64(text + size.astype(np.uint64)), return_index=True,
                                              return_inverse=True, return_counts=True)
                twice = n[back] > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[where].view(np.int64)), pa.array(text[where].view(np.int64)), pa.array(size[where]),
                     pa.array(n), pa.array(rid[where]), pa.array(p[where]), pa.array(np.full(len(where), -1, np.int64))],
                    ["anchor", "text_hash", "size", "copies", "rid", "first", "e"])
                if twice.any():
                    k = int(twice.sum())
                    z = pa.array(np.zeros(k, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [z, z, pa.array(np.zeros(k, np.int32)), z, pa.array(rid[twice]), pa.array(p[twice]),
                         pa.array(p[twice] + size[twice] - 1 + length)],
                        ["anchor", "text_hash", "size", "copies", "rid", "first", "e"])

    both = materialize(docs.mapInArrow(find, RUN + ", e LONG"), "runs")
    runs_, sure = both.filter("e = -1").drop("e"), both.filter("e >= 0").select("rid", F.col("first").alias("s"), "e")

    # Run texts, and anchors with more than one.
    texts = materialize(runs_.groupBy("anchor", "text_hash", "size").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("rid", "first")).alias("one")), "run-texts")
    copied = texts.filter("copies > 1").select("anchor", "text_hash", "size")
    copies = (runs_.filter("copies = 1").join(copied, ["anchor", "text_hash", "size"])
              .select("rid", F.col("first").alias("s"), (F.col("first") + F.col("size") - 1 + length).alias("e")))
    groups = (texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts"), F.min("copies").alias("fewest"),
                                          F.sum("size").alias("strings"))
              .filter("texts > 1 AND fewest = 1"))
    open_ = materialize(texts.join(groups, "anchor").select(
        "anchor", "size", "copies", "texts", F.col("one.rid").alias("rid"), F.col("one.first").alias("first")), "open")
    todo = (open_.groupBy("rid").agg(F.collect_list(F.struct("anchor", "first", "size", "copies", "texts")).alias("wanted")))

    def cut_out(batches):
        """The run texts that a document stands for."""
        for rb in batches:
            data, offsets = text_bytes(rb.column("text"))
            w = rb.column("wanted")
            flat, n = w.flatten(), pc.list_value_length(w).to_numpy()
            row = np.repeat(np.arange(rb.num_rows), n)
            first, size = flat.field("first").to_numpy(), flat.field("size").to_numpy()
            begin = offsets[row] + first
            end = begin + size - 1 + length
            raw, step = data.tobytes(), 4096
            for i in range(0, len(row), step):
                k = slice(i, i + step)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor")[k], rb.column("rid").take(pa.array(row[k])), flat.field("first")[k],
                     flat.field("copies")[k], flat.field("texts")[k],
                     pa.array([raw[b:e] for b, e in zip(begin[k].tolist(), end[k].tolist())], pa.binary())],
                    ["anchor", "rid", "first", "copies", "texts", "body"])

    # Equal rows have one rid: each of their run texts is kept once.
    bodies = materialize(docs.join(todo, "rid").select("rid", "text", "wanted").mapInArrow(
        cut_out, "anchor LONG, rid LONG, first LONG, copies LONG, texts LONG, body BINARY")
        .dropDuplicates(["anchor", "rid", "first"]), "bodies")
    total = bodies.filter(F.col("texts") <= group_texts).agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))

    def sort_bucket(table):
        body, rid, first = table.column("body").to_pylist(), table.column("rid").to_numpy(), table.column("first").to_numpy()
        once = table.column("copies").to_numpy() == 1
        out = [[], [], []]
        # About a megabyte at once; one anchor's texts stay together.
        anchors = table.column("anchor").to_numpy()
        order = np.argsort(anchors, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(anchors[order])) + 1, len(order))
        size = np.concatenate([[0], np.cumsum([len(body[i]) + 1 for i in order])])
        begin = 0
        for this, nxt in zip(edges, np.append(edges[1:], -1)):
            if nxt >= 0 and size[nxt] - size[begin] <= PIECE:
                continue
            pick, begin = order[begin:this], this
            for k, starts in zip(pick.tolist(), repeated_starts([body[k] for k in pick], length)):
                if once[k] and len(starts):
                    s, e = spans(starts, length)
                    out[0].append(np.full(len(s), rid[k]))
                    out[1].append(s + first[k])
                    out[2].append(e + first[k])
        cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
        return pa.Table.from_arrays(cols, ["rid", "s", "e"])

    sorted_ = (bodies.filter(F.col("texts") <= group_texts)
               .withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
               .groupBy("bucket").applyInArrow(sort_bucket, SPAN))

    # Anchors with very many run texts: hashes of their strings, counted by Spark.
    def hashed(batches):
        for rb in batches:
            for row in rb.to_pylist():
                data = np.frombuffer(row["body"], np.uint8)
                at = np.arange(len(data) - length + 1)
                key = mix64(Hashes(data).of(at, at + length) ^ np.uint64(row["anchor"] & 0xFFFFFFFFFFFFFFFF))
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.full(k, row["rid"])), pa.array(at + row["first"]),
                     pa.array(np.full(k, row["copies"]))], ["key", "rid", "s", "copies"])

    strings = bodies.filter(F.col("texts") > group_texts).mapInArrow(hashed, "key LONG, rid LONG, s LONG, copies LONG")
    twice = strings.groupBy("key").agg(F.sum("copies").alias("n")).filter("n > 1").select("key")
    counted = (strings.filter("copies = 1").join(twice, "key", "left_semi")
               .select("rid", "s", (F.col("s") + length).alias("e")))
    return sure.union(copies).union(sorted_).union(counted)


def remove(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every
    row; ``kept`` holds the remaining bytes."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    ranges = covered(docs.select("rid", "text").filter(F.octet_length("text") >= length), length, **options)
    # Equal rows list the same ranges: one of each is left before they are collected.
    lists = materialize(ranges.groupBy("rid", "s").agg(F.max("e").alias("e"))
                        .groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges")), "ranges")

    @arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:binary>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        flat, n = ranges.flatten(), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy()
        s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
        stop, out = np.cumsum(n), []
        for i in range(len(texts)):
            raw = data[offsets[i]:offsets[i + 1]]
            gone = np.zeros(len(raw) + 1, np.int64)
            a, b = s[stop[i] - n[i]:stop[i]], e[stop[i] - n[i]:stop[i]]
            np.add.at(gone, a, 1)
            np.add.at(gone, b, -1)
            gone = np.cumsum(gone)[:-1] > 0
            kept = raw[~gone].tobytes()
            edges = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((len(raw), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), kept))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return (docs.join(lists, "rid", "left").select("doc_id", cut("text", "ranges").alias("r"))
            .select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256", "r.kept"))
