"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned by ``doc_id``; every task tokenises its
range and writes one Arrow file whose record batches hold two fixed-size
lists: ``ids`` and ``mask`` (false: padding at the end of the file).  All
sequences have the same length, so sequence i of a file is found by
arithmetic and read by memory map without a copy.  A small Arrow file beside
it lists the documents with their lengths in ids, in the same order.  A task
writes under a name of its own and moves the file when it is whole, so a
repeated task replaces equal bytes.

Defined cases: a null or empty text is the end id alone; repeated rows are
documents of their own, ordered by doc_id, then text; null ids come first;
an empty table gives a manifest without documents.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, bounded_batches, materialize, process_cache, text_bytes
from lectern.llm.memo import PartTable, cuts

SEQ_LEN = 2048
BATCH_SEQS = 256
MANIFEST = "part INT, path STRING, n_docs LONG, n_tokens LONG, n_sequences LONG"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def unicode_space_before(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Cuts whose previous character is white space outside ASCII: the run
    of white space goes on, so the text must not be cut there."""
    a = data[p - 1]
    odd = np.flatnonzero(a >= 0x80)
    out = np.zeros(len(p), dtype=bool)
    if not len(odd):
        return out
    q = p[odd]
    a, b, c = data[q - 1], data[np.maximum(q - 2, 0)], data[np.maximum(q - 3, 0)]
    out[odd] = (((b == 0xC2) & ((a == 0x85) | (a == 0xA0)))
                | ((c == 0xE1) & (b == 0x9A) & (a == 0x80))
                | ((c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)))
                | ((c == 0xE2) & (b == 0x81) & (a == 0x9F))
                | ((c == 0xE3) & (b == 0x80) & (a == 0x80)))
    return out


def bpe_table(path: str) -> PartTable:
    """A worker's table of parts for a byte-level BPE file.  Its splitting
    pattern never joins white space to the character before it."""
    kept = process_cache("byte_bpe")
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        kept[path] = PartTable(lambda parts: [e.ids for e in tok.encode_batch_fast(parts, add_special_tokens=False)])
    return kept[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class _Writer:
    """One Arrow file of sequences and one of documents, filled in order."""

    def __init__(self, path: str, part: int, seq_len: int, id_type):
        self.fs, base = filesystem(path)
        self.fs.create_dir(base, recursive=True)
        tag = TaskContext.get().taskAttemptId()
        self.final = f"{base}/part-{part:05d}.arrow", f"{base}/part-{part:05d}.docs.arrow"
        self.temp = [f"{p}.{tag}.tmp" for p in self.final]
        self.seq_len, self.id_type = seq_len, id_type
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(id_type), seq_len)),
                                 ("mask", pa.list_(pa.bool_(), seq_len))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(t) for t in self.temp]
        self.seqs = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.rest, self.held = [], 0
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(lengths, pa.int64())], schema=self.docs_schema))
        self.n_docs += len(lengths)
        self.n_tokens += len(ids)
        self.rest.append(ids.astype(self.id_type))
        self.held += len(ids)
        if self.held >= self.seq_len * BATCH_SEQS:
            self._flush(self.held // (self.seq_len * BATCH_SEQS) * BATCH_SEQS)   # whole batches only

    def _flush(self, n: int, pad: int = 0) -> None:
        flat = np.concatenate([*self.rest, np.zeros(pad, self.id_type)])
        take = n * self.seq_len
        for i in range(0, n, BATCH_SEQS):
            ids = flat[i * self.seq_len:min(take, (i + BATCH_SEQS) * self.seq_len)]
            mask = np.ones(len(ids), dtype=bool)
            if pad and i + BATCH_SEQS >= n:
                mask[len(mask) - pad:] = False
            self.seqs.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))
        self.n_sequences += n
        self.rest, self.held = [flat[take:]], len(flat) - take

    def close(self) -> None:
        if self.held:
            pad = -self.held % self.seq_len
            self._flush((self.held + pad) // self.seq_len, pad)
        for w, s, t, f in zip((self.seqs, self.docs), self.sinks, self.temp, self.final):
            w.close()
            s.close()
            self.fs.move(t, f)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
                    seq_len: int = SEQ_LEN) -> DataFrame:
    """Write ``docs`` (doc_id, text, ...) and return the manifest, one row
    per file: ``part, path, n_docs, n_tokens, n_sequences``."""
    bounded_batches(docs.sparkSession)
    id_type = np.uint16 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else np.uint32

    def write(batches):
        table, out = bpe_table(tokenizer), None
        part = TaskContext.get().partitionId()
        for rb in batches:
            if not rb.num_rows:
                continue
            out = out or _Writer(folder, part, seq_len, id_type)
            data, offsets = text_bytes(rb.column("text"))
            starts, ends, first = cuts(data, offsets, SPACE, unicode_space_before)
            ids, sizes = table.encode(data, starts, ends)
            stop = np.concatenate([[0], np.cumsum(sizes)])[first]
            lengths = np.diff(stop) + 1
            out.add(rb.column("doc_id"), np.insert(ids, stop[1:], end_id), lengths)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": out.final[0], "n_docs": out.n_docs, "n_tokens": out.n_tokens,
                  "n_sequences": out.n_sequences}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                                  ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest")


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """An Arrow file of sequences; local files are memory-mapped."""
    fs, p = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(p))
    return pa.ipc.open_file(fs.open_input_file(p))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``i``; the ids are a view of the file."""
    batch = reader.get_batch(i // BATCH_SEQS)
    ids, mask = batch.column("ids")[i % BATCH_SEQS].values, batch.column("mask")[i % BATCH_SEQS].values
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32``."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "path", "n_tokens",
                            F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def one(path: str, total: int, start: int):
        reader, docs = open_sequences(path), open_sequences(path[:-len(".arrow")] + ".docs.arrow")
        flat, at, used, seen = np.zeros(0, np.uint32), 0, 0, 0
        for b in range(docs.num_record_batches):
            rows = docs.get_batch(b)
            lengths = rows.column("n_tokens").to_numpy()
            sums = np.zeros(len(lengths), dtype=np.int64)
            for k, n in enumerate(lengths.tolist()):
                crc = 0
                while n:
                    if used == len(flat):
                        batch = reader.get_batch(at)
                        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
                        flat, used, at = batch.column("ids").flatten().to_numpy()[mask].astype("<u4"), 0, at + 1
                        seen += len(flat)
                    got = flat[used:used + n]
                    crc = zlib.crc32(got.tobytes(), crc)
                    used, n = used + len(got), n - len(got)
                sums[k] = crc
            begin = start + np.cumsum(lengths) - lengths
            start += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(begin), rows.column("n_tokens"),
                                              pa.array(sums)], schema=schema)
        if seen != total or used != len(flat) or at != reader.num_record_batches:
            raise ValueError(f"{path}: {seen} ids in the file, {total} in the manifest")

    def read(batches):
        for rb in batches:
            for row in rb.to_pylist():
                yield from one(row["path"], row["n_tokens"], row["start"])

    n = max(1, manifest.count())
    return (files.repartition(min(n, 10_000), "part")
            .mapInArrow(read, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG"))
