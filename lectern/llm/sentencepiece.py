"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation is the one with the largest sum of piece scores.  The
search keeps, for each character boundary, the best score and the boundary
it came from; only boundaries within the longest piece of the end can be
extended.  When all of those lead back to one boundary, everything before
it is decided: its ids are committed and the window is cut there.

No piece of a model joins a space mark to the character before it, so all
paths meet at every such boundary, and words that recur are searched once
per worker (``memo``).  Models whose pieces do join them are refused.

Defined cases: a null text gives null, an empty text an empty list;
unknown characters become byte pieces, or the unknown id where the model has
none.  Decoding gives the text back where it has no space marks (U+2581) of
its own and the model has byte pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import bounded_batches, process_cache, release, text_bytes
from lectern.llm.memo import PartTable, cuts

MARK = "▁"
WHOLE = 64               # characters of a part that is searched at once
UNKNOWN_PENALTY = 10.0   # below the smallest score, as the library has it


class Model:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n)
                       if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece joins a space mark to the character before it")
        self.longest = max(map(len, self.pieces))
        # Scores of the pieces; None for what only begins a longer piece.
        self.scores = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | {p: s for p, (_, s) in self.pieces.items()}
        self.unk_score = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        raw = [b""] * n
        for p, (i, _) in self.pieces.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            raw[i] = bytes([b])
        if self.unk >= 0:
            raw[self.unk] = " ⁇ ".encode()
        self.raw = raw

    def ids_of(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is not None:
            return [got[0]]
        if len(self.byte_ids) == 256:
            return [self.byte_ids[b] for b in piece.encode("utf-8")]
        return [self.unk]

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that arrives in chunks, each as soon as decided."""
        text, score, came = "", [0.0], [0]
        pieces, longest = self.pieces, self.longest
        for chunk in chunks:
            text += chunk
            while len(score) <= len(text):
                end = len(score)
                best, origin = None, end - 1
                for start in range(max(0, end - longest), end):
                    got = pieces.get(text[start:end])
                    if got is not None:
                        s = score[start] + got[1]
                    elif start == end - 1:
                        s = score[start] + self.unk_score
                    else:
                        continue
                    if best is None or s > best:
                        best, origin = s, start
                score.append(best)
                came.append(origin)
                if end >= 4 * longest and end % longest == 0:
                    # Boundaries that a later piece can start from.
                    live = set(range(end - longest + 1, end + 1))
                    while len(live) > 1:
                        top = max(live)
                        live.remove(top)
                        live.add(came[top])
                    at = live.pop()
                    if at:
                        yield self._trace(text, came, at)
                        text = text[at:]
                        score = [s - score[at] for s in score[at:]]
                        came = [max(0, c - at) for c in came[at:]]
        if text:
            yield self._trace(text, came, len(text))

    def search(self, text: str) -> list[int]:
        """Ids of a text that is there whole: ``stream``'s segmentation, found
        from each boundary forwards for as long as a piece may still begin so."""
        n = len(text)
        score, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
        scores, unknown, none = self.scores, self.unk_score, math.nan
        for start in range(n):
            here, end = score[start], start + 1
            got = scores.get(text[start:end], none)
            s = here + (unknown if got is None or got is none else got)
            if s > score[end]:
                score[end], came[end] = s, start
            while got is not none and end < n:
                end += 1
                got = scores.get(text[start:end], none)
                if got is not None and here + got > score[end]:     # false for none
                    score[end], came[end] = here + got, start
        return self._trace(text, came, n) if n else []

    def _trace(self, text: str, came: list[int], end: int) -> list[int]:
        parts = []
        while end:
            parts.append(text[came[end]:end])
            end = came[end]
        return [i for p in reversed(parts) for i in self.ids_of(p)]

    def encode(self, text: str) -> list[int]:
        """Ids of one text (with the leading space mark)."""
        if not text:
            return []
        marked = (" " + text).replace(" ", MARK)
        return [i for ids in self.stream(marked[k:k + 4096] for k in range(0, len(marked), 4096)) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _model(path: str) -> tuple[Model, PartTable]:
    kept = process_cache("sentencepiece")
    if path not in kept:
        model = Model(path)

        def search(parts: list[str]) -> list[list[int]]:
            marked = [p.replace(" ", MARK) for p in parts]
            return [model.search(p) if len(p) <= WHOLE else [i for ids in model.stream([p]) for i in ids] for p in marked]
        kept[path] = model, PartTable(search)
    return kept[path]


ONLY_SPACE = np.zeros(256, dtype=bool)
ONLY_SPACE[32] = True


def encoder(path: str):
    """Column function: text -> list of ids."""
    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        model, table = _model(path)
        # The leading mark, then parts: spaces with what follows them.
        marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", " "), texts, "")
        data, offsets = text_bytes(marked)
        starts, ends, first = cuts(data, offsets, ONLY_SPACE)
        ids, sizes = table.encode(data, starts, ends)
        stop = np.concatenate([[0], np.cumsum(sizes)])[first].astype(np.int32)
        del starts, ends, sizes
        release()
        return pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(ids, pa.int32()),
                                        mask=pc.is_null(texts) if texts.null_count else None)
    return encode


def decoder(path: str):
    """Column function: list of ids -> text."""
    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        model, _ = _model(path)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        stop = np.cumsum(n)
        # Text by text: ids as Python numbers take ten times their room.
        out = pa.array((None if v else model.decode(flat[e - k:e].tolist())
                        for k, e, v in zip(n.tolist(), stop.tolist(), pc.is_null(ids).to_pylist())), pa.string())
        release()
        return out
    return decode


def encode_texts(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of ``text``; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(ids, encoder(model)(F.col(text)))


def decode_ids(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, decoder(model)(F.col(ids)))
