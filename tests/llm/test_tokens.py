import glob
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import tokens
from tests.llm.conftest import documents

TEXTS = ["Hello  world\n\n again", "", None, "a \n x", "  lead", "trail  \n\n", "a\x1c b  c <|endoftext|> d<|endoftext|>  e",
         "x  \n y\u0085  z　 w", "it's 'll 're we've", "日本 語 🙂", "word " * 20000, "q" * 9000, "a b", "a b"]


@pytest.fixture(scope="module")
def written(spark, bpe_path, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tokens"))
    ids = [None, *range(5, 5 + len(TEXTS) - 1)]
    ids[-1] = ids[-2]
    manifest = tokens.write_sequences(documents(spark, TEXTS, ids=ids), folder, bpe_path, end_id=2, seq_len=64)
    return folder, ids, manifest


def expected(ids, path):
    tok, start = Tokenizer.from_file(path), 0
    for i, t in sorted(zip(ids, TEXTS), key=lambda x: (x[0] is not None, x[0] or 0)):
        got = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        yield i, start, len(got), zlib.crc32(got.tobytes()), got
        start += len(got)


def test_documents_read_back(written, bpe_path):
    folder, ids, manifest = written
    got = sorted((tuple(r) for r in tokens.read_documents(manifest).collect()), key=lambda r: r[1])
    assert got == [x[:4] for x in expected(ids, bpe_path)]


def test_sequences_are_equal_length_views_of_the_file(written, bpe_path):
    folder, ids, manifest = written
    files = [(r["path"], r["n_sequences"], r["n_tokens"]) for r in manifest.orderBy("part").collect()]
    assert not glob.glob(folder + "/*.tmp")
    flat = []
    for path, n, total in files:
        reader = tokens.open_sequences(path)
        seqs = [tokens.sequence(reader, i) for i in range(n)]
        assert all(len(a) == len(m) == 64 for a, m in seqs) and sum(m.sum() for _, m in seqs) == total
        assert not seqs[0][0].flags.owndata and not seqs[0][0].flags.writeable
        flat += [a[m] for a, m in seqs]
    assert np.concatenate(flat).tolist() == [int(t) for x in expected(ids, bpe_path) for t in x[4]]


def test_empty_table(spark, bpe_path, tmp_path):
    manifest = tokens.write_sequences(documents(spark, []), str(tmp_path), bpe_path, end_id=2)
    assert manifest.collect() == [] and tokens.read_documents(manifest).collect() == []


def test_a_damaged_file_is_noticed(written):
    from pyspark.sql import functions as F
    folder, ids, manifest = written
    wrong = manifest.withColumn("n_tokens", F.col("n_tokens") + 1)
    with pytest.raises(Exception, match="in the manifest"):
        tokens.read_documents(wrong).collect()
