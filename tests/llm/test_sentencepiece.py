import random

import pytest

from lectern.llm import sentencepiece as S
from tests.llm.conftest import documents


def unigram_reference(path):
    """The library's own Viterbi: the same pieces and scores in a model whose
    type says unigram (field 3 of the trainer's settings)."""
    import sentencepiece
    raw = open(path, "rb").read()

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return n, i

    def enc(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def fields(b):
        i = 0
        while i < len(b):
            tag, j = varint(b, i)
            if tag & 7 == 2:
                n, j = varint(b, j)
                yield tag, b[j:j + n]
                i = j + n
            else:
                size = {1: 8, 5: 4}.get(tag & 7)
                k = j + size if size else varint(b, j)[1]
                yield tag, b[j:k]
                i = k

    out = b""
    for tag, body in fields(raw):
        if tag >> 3 == 2:
            inner = b""
            for t, v in fields(body):
                v = enc(1) if t >> 3 == 3 else v
                inner += enc(t) + (enc(len(v)) if t & 7 == 2 else b"") + v
            body = inner
        out += enc(tag) + (enc(len(body)) if tag & 7 == 2 else b"") + body
    return sentencepiece.SentencePieceProcessor(model_proto=out)


TEXTS = ["Hello world", "  two  spaces ", "tab\tand\nline", "naïve café — “quotes”", "日本語のテキスト", "🙂🙂 emoji 🙂",
         "a", " ", "\n", "supercalifragilisticexpialidocious", "x" * 300, "aaaa bbbb" * 20, "Ünïcödé ßtraße", "1234567890" * 8]


@pytest.fixture(scope="module")
def model(model_path):
    return S.Model(model_path)


def test_best_segmentation_equals_the_library(model, model_path):
    ref = unigram_reference(model_path)
    rng = random.Random(5)
    letters = "abcdefghij éüñ日🙂\n"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    for t in texts:
        assert model.encode(t) == ref.encode(t), t
        assert model.decode(model.encode(t)) == t


def score(model, ids):
    by = {i: s for i, s in model.pieces.values()}
    return sum(by[i] for i in ids if i in by)


def test_streaming_does_not_depend_on_chunks_and_commits_early(model):
    text = "▁" + "▁".join(["streaming", "search", "x" * 200, "commits", "ids"] * 200)
    whole = [i for ids in model.stream([text]) for i in ids]
    for n in (1, 7, 1000):
        parts = list(model.stream(text[k:k + n] for k in range(0, len(text), n)))
        assert [i for ids in parts for i in ids] == whole
        assert len(parts) > 50 and max(map(len, parts)) < 600


def test_columns(spark, model, model_path):
    texts = [*TEXTS, None, "", "Hello world", "word " * 30000, "y" * 50000]
    docs = documents(spark, texts)
    rows = S.decode_ids(S.encode_texts(docs, model_path), model_path).orderBy("doc_id").collect()
    for t, r in zip(texts, rows):
        assert r["decoded"] == t
        assert r["ids"] == (None if t is None else model.encode(t))
    empty = S.decode_ids(S.encode_texts(documents(spark, []), model_path), model_path)
    assert empty.collect() == []


def test_marks_in_the_text_read_as_spaces(model):
    assert model.decode(model.encode("a▁b")) == "a b"


def test_a_short_part_is_searched_forwards_with_the_same_ids_and_fewer_lookups(model):
    import random
    r, looked = random.Random(5), [0, 0]

    class Counted(dict):
        def get(self, key, default=None):
            looked[self.which] += 1
            return super().get(key, default)

    counted = object.__new__(S.Model)
    counted.__dict__ |= model.__dict__
    counted.scores, counted.pieces = Counted(model.scores), Counted(model.pieces)
    counted.scores.which, counted.pieces.which = 0, 1
    pieces = list(model.pieces)
    for _ in range(3000):
        text = "".join(r.choice([r.choice(pieces), r.choice("abé漢 z9.-▁")]) for _ in range(r.randint(0, 9)))[:S.WHOLE]
        assert model.search(text) == [i for ids in model.stream([text]) for i in ids]
    looked[:] = [0, 0]
    words = ["▁thenanor", "▁andreorstnt", "▁verberge.", "▁isonreingsh", "▁onviment,"] * 20
    for w in words:
        counted.search(w)
    forward, looked[:] = looked[0], [0, 0]
    for w in words:
        list(counted.stream([w]))
    assert forward < 0.8 * looked[1]


def test_a_lookup_needs_little_beside_its_parts(monkeypatch):
    """Few parts at a time: the ids are those of one lookup of all parts, and
    what it needs besides them does not grow with the parts of a batch."""
    import tracemalloc

    import numpy as np

    from lectern.llm import memo

    words = [f" w{k}" for k in range(500)]
    picked = [words[k * k % 500] for k in range(400_000)]
    data = np.frombuffer("".join(picked).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in picked])
    starts = np.append(0, ends[:-1])

    def lookup():
        return memo.PartTable(lambda parts: [[len(p), int(p[2:])] for p in parts]).encode(data, starts, ends)

    tracemalloc.start()
    ids, sizes = lookup()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.reshape(-1, 2).tolist() == [[len(w), int(w[2:])] for w in picked] and set(sizes.tolist()) == {2}
    assert peak - ids.nbytes - sizes.nbytes < 40 * len(picked)
    monkeypatch.setattr(memo, "AT_ONCE", len(picked))
    assert all(np.array_equal(a, b) for a, b in zip(lookup(), (ids, sizes)))


def test_a_table_that_fills_up_within_a_batch_gives_the_same_ids(monkeypatch):
    import numpy as np

    from lectern.llm import memo

    monkeypatch.setattr(memo, "AT_ONCE", 7)
    words = [f" {k % 40}" for k in range(300)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    table = memo.PartTable(lambda parts: [[int(p)] * (int(p) % 3) for p in parts], max_parts=10)
    ids, sizes = table.encode(data, np.append(0, ends[:-1]), ends)
    assert sizes.tolist() == [int(w) % 3 for w in words]
    assert ids.tolist() == [int(w) for w in words for _ in range(int(w) % 3)]
