"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads runs of letter bytes (ASCII letters and bytes >= 0x80) from
both ends, its state starting anew at each run, and labels every byte
position.  A document's probabilities are the means over all its positions, so
every byte of a letter counts.  Equal runs get equal labels and are computed
once per worker.  A run of any length is read whole, ``WINDOW`` bytes at a
time: the forward states at the windows' edges are kept, the windows are then
labelled from the last to the first, and the backward state is carried on.

The weights are learned here, in numpy, by backpropagation through time on a
bounded sample of labelled documents: the ``SAMPLE_DOCS`` of each language
with the smallest hashes, at most ``SAMPLE_RUNS`` runs of each, longer ones in
pieces of ``WINDOW`` bytes; the ``LANGUAGES`` with most documents where there
are more.

Defined cases: a null or empty text, or one without a letter, gets ``und``
with score 0; rows without a language are not learned from; without any
labelled row every text gets ``und``; result columns replace input columns
of the same names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import bounded_batches, mix64, process_cache, release, run_hashes, runs, text_bytes

SAMPLE_DOCS = 200        # labelled documents of each language that the fit sees
SAMPLE_RUNS = 250        # runs of letters of each of them
HIDDEN = 16
STEPS = 350
MINIBATCH = 256
WINDOW = 48              # bytes that are labelled at once; of a run in the sample at most
LANGUAGES = 1000         # languages that are learned at most
CELLS = 1 << 18          # runs x labels of a block at most
KEPT_RUNS = 400_000    # runs whose labels a worker keeps
UNDETERMINED = "und"

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray, longest: int = 0):
    """Runs of letter bytes: starts, ends, rows; in pieces of ``longest``
    bytes at most where that is given."""
    s, e, row = runs(LETTER[data], offsets)
    if longest and len(s) and int((e - s).max()) > longest:
        n = -(-(e - s) // longest)
        first = np.repeat(s, n) + longest * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        e, row, s = np.minimum(first + longest, np.repeat(e, n)), np.repeat(row, n), first
    return s, e, row


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def batch_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of runs, padded on the right: (time, run), and their lengths."""
    n = ends - starts
    t = np.arange(int(n.max()))[:, None]
    inside = t < n[None, :]
    return np.where(inside, data[np.minimum(starts[None, :] + t, len(data) - 1)], 0), n


class Network:
    """Weights of both directions and of the position labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.w = {}
        for d in "fb":
            # Inputs of the update, reset and candidate gates side by side.
            self.w["x" + d], self.w["u" + d] = f(256, 3 * hidden), f(hidden, 3 * hidden)
            self.w["b" + d] = np.zeros(3 * hidden, np.float32)
        self.w["o"], self.w["ob"] = f(2 * hidden, len(labels)), np.zeros(len(labels), np.float32)

    def _direction(self, x, n, d, keep, state=None):
        """States at every position, from ``state`` on; a run's state is held beyond its end."""
        h, (T, B) = self.h, x.shape
        wx, wu, b = self.w["x" + d], self.w["u" + d], self.w["b" + d]
        state = np.zeros((B, h), wx.dtype) if state is None else state
        out, tape = np.zeros((T, B, h), wx.dtype), []
        for t in (range(T) if d == "f" else range(T - 1, -1, -1)):
            live = (t < n)[:, None]
            a, r = wx[x[t]] + b, state @ wu[:, :2 * h]
            zr = _sigmoid(a[:, :2 * h] + r)
            z, q = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h:] + (q * state) @ wu[:, 2 * h:])
            new = np.where(live, (1 - z) * state + z * c, state)
            if keep:
                tape.append((t, state, z, q, c, live))
            state = new
            out[t] = state
        return out, tape

    def positions(self, x, n, keep=False):
        """Label probabilities at every position: (time, run, label)."""
        hf, tf = self._direction(x, n, "f", keep)
        hb, tb = self._direction(x, n, "b", keep)
        p, hidden = self._labels(hf, hb)
        return (p, hidden, tf, tb) if keep else p

    def _labels(self, hf, hb):
        hidden = np.concatenate([hf, hb], axis=2)
        logit = hidden @ self.w["o"] + self.w["ob"]
        logit -= logit.max(axis=2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=2, keepdims=True)
        return p, hidden

    def gradients(self, x, n, y):
        """Mean cross entropy of all positions and its gradients."""
        p, hidden, tf, tb = self.positions(x, n, keep=True)
        T, B = x.shape
        live = (np.arange(T)[:, None] < n[None, :])[..., None]
        total = float(n.sum())
        truth = p[np.arange(T)[:, None], np.arange(B)[None, :], y[None, :]]
        loss = -float((np.log(np.maximum(truth, 1e-12)) * live[..., 0]).sum()) / total
        d = p.copy()
        d[:, np.arange(B), y] -= 1
        d = np.where(live, d, 0) / total
        g = {"o": np.einsum("tbh,tbl->hl", hidden, d), "ob": d.sum((0, 1))}
        back = d @ self.w["o"].T
        h = self.h
        for name, tape, dh in (("f", tf, back[..., :h]), ("b", tb, back[..., h:])):
            wu = self.w["u" + name]
            gx, gu, gb = np.zeros_like(self.w["x" + name]), np.zeros_like(wu), np.zeros(3 * h, wu.dtype)
            carry = np.zeros((B, h), wu.dtype)
            for t, prev, z, q, c, on in reversed(tape):
                total_d = carry + dh[t]
                dn = np.where(on, total_d, 0)
                dc = dn * z * (1 - c * c)
                dz = dn * (c - prev) * z * (1 - z)
                dqs = dc @ wu[:, 2 * h:].T
                dq = dqs * prev * q * (1 - q)
                da = np.concatenate([dz, dq, dc], axis=1)
                gx += (x[t][None, :] == np.arange(256)[:, None]).astype(np.float32) @ da
                gb += da.sum(0)
                gu[:, :2 * h] += prev.T @ da[:, :2 * h]
                gu[:, 2 * h:] += (q * prev).T @ dc
                carry = np.where(on, dn * (1 - z) + dqs * q + da[:, :2 * h] @ wu[:, :2 * h].T, total_d)
            g |= {"x" + name: gx, "u" + name: gu, "b" + name: gb}
        return loss, g

    def fit(self, data, starts, ends, y, steps: int = STEPS, minibatch: int = MINIBATCH, seed: int = 11) -> list[float]:
        """Adam on minibatches in which all labels have the same weight."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, max(1, minibatch // len(by))) for rows in by if len(rows)])
            x, n = batch_of(data, starts[pick], ends[pick])
            loss, g = self.gradients(x, n, y[pick])
            losses.append(loss)
            rate = 0.01 * (1 - step / (steps + 1))
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return losses

    def run_sums(self, data, starts, ends, block: int = 4096) -> np.ndarray:
        """Sum of the position probabilities of each run, by label."""
        out = np.zeros((len(starts), len(self.labels)), np.float32)
        block = max(1, min(block, CELLS // max(1, len(self.labels))))
        order = np.argsort(ends - starts, kind="stable")
        for i in range(0, len(order), block):
            rows = order[i:i + block]
            out[rows] = self._sums(data, starts[rows], ends[rows])
        return out

    def _sums(self, data, starts, ends) -> np.ndarray:
        """``run_sums`` of runs in ascending order of length, a window at a time."""
        n, h = ends - starts, self.h
        edges = range(0, max(int(n.max()), 1), WINDOW)
        # Of each window only the runs that reach it: those from ``live`` on.
        live = [int(np.searchsorted(n, a, side="right")) if a else 0 for a in edges]

        def window(i):
            k, a = live[i], edges[i]
            return batch_of(data, starts[k:] + a, np.minimum(ends[k:], starts[k:] + a + WINDOW))

        before = [np.zeros((len(n), h), self.w["xf"].dtype)]
        for i in range(len(edges) - 1):
            last = self._direction(*window(i), "f", False, before[i])[0][-1]
            before.append(last[live[i + 1] - live[i]:])
        out, after = np.zeros((len(n), len(self.labels))), np.zeros((len(n), h), self.w["xb"].dtype)
        for i in reversed(range(len(edges))):
            x, m = window(i)
            k = live[i]
            hf = self._direction(x, m, "f", False, before.pop())[0]
            hb = self._direction(x, m, "b", False, after[k:])[0]
            after[k:] = hb[0]
            p, _ = self._labels(hf, hb)
            out[k:] += (p * (np.arange(x.shape[0])[:, None] < m[None, :])[..., None]).sum(axis=0)
        return out


def training_sample(docs: DataFrame, learn: Column, docs_per_label: int = SAMPLE_DOCS,
                    runs_per_doc: int = SAMPLE_RUNS) -> pd.DataFrame:
    """Bounded sample for the fit: ``lang`` and up to ``runs_per_doc`` runs
    of letters, one row per document."""
    bounded_batches(docs.sparkSession)
    key = F.xxhash64("doc_id")
    named = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Which documents: from the narrow columns alone.
    ranked = (named.select("lang", key.alias("key"))
              .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
              .filter(F.col("r") <= docs_per_label))
    limits = ranked.groupBy("lang").agg(F.max("key").alias("last"))
    sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    limits = limits.join(sizes, "lang").select("lang", "last").collect()      # LANGUAGES rows at most
    if not limits:
        return pd.DataFrame({"lang": [], "runs": []})
    small = docs.sparkSession.createDataFrame([(r["lang"], r["last"]) for r in limits], "lang STRING, last LONG")

    @arrow_udf("string")
    def some_runs(texts: pa.Array) -> pa.Array:
        process_cache("language")       # what an earlier stage kept goes before the first batch
        data, offsets = text_bytes(texts)
        s, e, row = letter_runs(data, offsets, WINDOW)
        order = np.argsort(mix64(run_hashes(data, s, e) + np.arange(len(s), dtype=np.uint64)), kind="stable")
        order = order[np.argsort(row[order], kind="stable")]
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order = order[rank < runs_per_doc]
        raw, out = data.tobytes(), [[] for _ in range(len(texts))]
        for i in order.tolist():
            out[row[i]].append(raw[s[i]:e[i]])
        return pa.array([b" ".join(x).hex() for x in out], pa.string())

    return (named.withColumn("key", key).join(F.broadcast(small), "lang").filter("key <= last")
            .select("lang", "key", some_runs("text").alias("runs")).orderBy("lang", "key", "runs").toPandas())


def train(sample: pd.DataFrame, hidden: int = HIDDEN, steps: int = STEPS) -> Network:
    labels = sorted(set(sample["lang"]), key=lambda s: s.encode())
    texts = [bytes.fromhex(r) for r in sample["runs"]]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    net = Network(labels, hidden)
    s, e, row = letter_runs(data, offsets, WINDOW)
    if len(s) and len(labels) > 1:
        y = np.array([labels.index(x) for x in sample["lang"]])[row]
        net.fit(data, s, e, y, steps)
    return net


class RunTable:
    """Sums of labels of runs that a worker has met."""

    def __init__(self, net: Network):
        self.net, self.keys, self.sums = net, np.zeros(0, np.uint64), np.zeros((0, len(net.labels)), np.float32)

    def lookup(self, data, s, e) -> np.ndarray:
        keys, where, at = np.unique(run_hashes(data, s, e), return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(known, len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) > KEPT_RUNS:
                self.keys, self.sums = self.keys[:0], self.sums[:0]
                new[:] = True
            rows = where[new]
            fresh = self.net.run_sums(data, s[rows], e[rows])
            pos = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, pos, keys[new])
            self.sums = np.insert(self.sums, pos, fresh, axis=0)
            known = np.searchsorted(self.keys, keys)
        return self.sums[known][at]


def classify(docs: DataFrame, net: Network, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of ``text`` and its probability."""
    bounded_batches(docs.sparkSession)
    if not net.labels:
        return docs.withColumn(label, F.lit(UNDETERMINED)).withColumn(score, F.lit(0.0))
    # Arrays and strings only, so that executors need not have this module.
    shared = docs.sparkSession.sparkContext.broadcast((net.labels, net.h, net.w))
    stamp = int(abs(float(sum(np.abs(w).sum(dtype=np.float64) for w in net.w.values()))) * 1e6)

    @arrow_udf("struct<label:string,score:double>")
    def pooled(texts: pa.Array) -> pa.Array:
        kept = process_cache("language")
        if kept.get("stamp") != stamp:
            labels, hidden, weights = shared.value
            fresh = Network(labels, hidden)
            fresh.w = weights
            kept.update(stamp=stamp, table=RunTable(fresh))
        model = kept["table"].net
        data, offsets = text_bytes(texts)
        s, e, row = letter_runs(data, offsets)
        total = np.zeros((len(texts), len(model.labels)))
        if len(s):
            sums = kept["table"].lookup(data, s, e)
            for k in range(len(model.labels)):
                total[:, k] = np.bincount(row, sums[:, k], minlength=len(texts))
        mass = total.sum(axis=1)
        best = total.argmax(axis=1)
        # Single-precision sums differ in the last digits with the batch a run is computed in.
        p = np.round(np.clip(total[np.arange(len(texts)), best] / np.where(mass > 0, mass, 1), 0, 1), 6)
        names = [model.labels[b] if w > 0 else UNDETERMINED for b, w in zip(best.tolist(), mass.tolist())]
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(p, pa.float64())], ["label", "score"])

    letters = F.col("text").rlike(r"\p{L}")
    # As if not deterministic: a caller's filter on the label would otherwise be
    # pushed below this step with a labelling of its own, and every text be
    # labelled twice, in two workers for each task.
    got = docs.withColumn("_got", pooled.asNondeterministic()(F.col("text")))
    return (got.withColumn(label, F.when(letters, F.col("_got.label")).otherwise(UNDETERMINED))
            .withColumn(score, F.when(letters, F.col("_got.score")).otherwise(0.0)).drop("_got"))
