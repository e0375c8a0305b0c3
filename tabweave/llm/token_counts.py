"""Token counts of whole texts.  Huge texts are encoded in overlapping chunks with offsets, which are spliced where the encodings agree.

Why a splice is right.  The model merges the neighbours of highest score, leftmost first, until none can be merged.  Let A be the
encoding of a text up to some place and B that of a later, overlapping stretch, and let both hold the same token X at the same place.
No merge crossed X's ends, neither in A nor in B, so what lies before X was merged in A as it would be alone, X alike in both, and what
lies after X in B as it would be alone.  In the whole text the first merge to cross an end of X would join two symbols that also
met, in the same order of merges, in A (its start) or in B (its end), where that merge did not happen.  So the whole text's tokens are A's up
to X and B's after it."""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_file

from .common import map_texts, text_pieces

#: Code points of a chunk, and of the first overlap of two chunks.
CHUNK, OVERLAP = 1 << 15, 256
DEFAULT = "piece_bpe_32k.model"


@functools.cache
def default_model() -> str:
    return public_tokenizers.path(DEFAULT)


class Counter:
    """Numbers of tokens as the library gives them, without begin and end tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        spec = model_file.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        normal, trained = spec.normalizer_spec, spec.trainer_spec
        #: Whether the proof holds: merges by score over the characters as they are.  Other models encode whole texts.
        self.splices = (trained.model_type == trained.BPE and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces
                        and not trained.treat_whitespace_as_suffix)

    def whole(self, texts: list[bytes]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1, return_type="numpy")]

    def _tokens(self, text: str, first: int, past: int) -> np.ndarray:
        """Rows of (first, past, id) of the tokens of a stretch, in code points of the whole text."""
        found = self.model.encode(text[first:past], return_type="offset_mapping")
        spans = np.array(found["offsets"], np.int64).reshape(-1, 2) + first
        return np.column_stack([spans, np.array(found["ids"], np.int64)])

    def spliced(self, text: str) -> tuple[int, int, int]:
        """(tokens, chunks, chunks encoded again with a wider overlap) of a text."""
        done, chunk, chunks, widened = 0, self.chunk, 1, 0
        past = min(chunk, len(text))
        held = self._tokens(text, 0, past)  # the last chunk's tokens, of which those not yet counted belong to the text
        while past < len(text):
            back, end = self.overlap, min(past + chunk, len(text))
            while True:
                first = max(0, past - back)
                new = self._tokens(text, first, end)
                chunks += 1
                if first == 0:  # all from the start: nothing to splice
                    done, held = 0, new
                    break
                if shared := _shared(held, new):
                    done, held = done + shared[0] + 1, new[shared[1] + 1:]
                    break
                widened += 1
                back += back + 1  # an odd step, so texts with a period are met at another phase
            if first == 0:
                chunk *= 2
            past = end
        return done + len(held), chunks, widened

    def counts(self, texts: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
        """Bytes, tokens, chunks and widened chunks of each text."""
        n_bytes, tokens, chunks, widened = [], [], [], []
        for _, _, data, offsets in text_pieces(texts):
            raw = data.tobytes()
            rows = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            long = [self.splices and len(r) > self.chunk for r in rows]
            short = iter(self.whole([r for r, is_long in zip(rows, long, strict=True) if not is_long]))
            for r, is_long in zip(rows, long, strict=True):
                found = self.spliced(r.decode()) if is_long else (next(short), 1, 0)
                n_bytes.append(len(r))
                for out, x in zip((tokens, chunks, widened), found, strict=True):
                    out.append(x)
        return n_bytes, tokens, chunks, widened


def _shared(held: np.ndarray, new: np.ndarray) -> tuple[int, int] | None:
    """Places in both lists of one token that both have; tokens without characters (bytes of one character) do not count."""
    first, past = new[0, 0], held[-1, 1] if len(held) else 0
    a = np.flatnonzero((held[:, 0] >= first) & (held[:, 1] > held[:, 0]))
    b = np.flatnonzero((new[:, 1] <= past) & (new[:, 1] > new[:, 0]))
    _, i, j = np.intersect1d(held[a, 0], new[b, 0], assume_unique=True, return_indices=True)
    same = np.flatnonzero((held[a[i]] == new[b[j]]).all(axis=1))
    if not len(same):
        return None
    at = same[len(same) // 2]
    return int(a[i[at]]), int(b[j[at]])


def count_tokens(docs: DataFrame, keep: list[str], model: str | None = None, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc, n_bytes, n_tokens, n_chunks, n_widened) for every row of ``docs``; ``doc`` is a struct of the ``keep`` columns.

    One scan without a shuffle.  A text of more than ``chunk`` bytes is encoded in chunks, so the encoder holds one chunk's symbols whatever the
    text's length; the text itself and its decoded form are in memory (up to five times its bytes).  If two chunks share no token, the overlap is
    doubled, at last back to the text's start, and later chunks are doubled too, so a text without any such place costs a small multiple
    of its own length.  The model's path must be readable on every executor.

    Null and empty texts have no bytes and no tokens; repeated rows each get their row; an empty table gives no rows; other columns are ignored."""
    path = model or default_model()

    def make():
        counter = Counter(path, chunk, overlap)
        return lambda texts: [pa.array(x, pa.int64()) for x in counter.counts(texts)]

    return map_texts(docs, make, "n_bytes long, n_tokens long, n_chunks long, n_widened long", keep, text)
