"""Texts as blank-separated chunks that a tokenizer treats independently.

A chunk is a run of blanks with the characters up to the next blank.  Chunks repeat, so a
tokenizer only sees a batch's distinct ones.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import coded, kept_between_tasks

#: Fixed value: the public pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUNS = re.compile(r" *[^ ]+(?: +\Z)?| +\Z")


def split_at_blanks(texts: pa.Array, odd: str, whole) -> tuple[np.ndarray, pa.ListArray]:
    """``(row numbers, parts)``: texts split at single blanks; those that match ``odd`` (RE2)
    are split by ``whole`` instead.  Row numbers tell which text each list is of."""
    strange = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False).astype(bool)
    plain, rest = np.flatnonzero(~strange), np.flatnonzero(strange)
    kind = pa.list_(pa.string())
    parts = [pc.split_pattern(texts.take(pa.array(plain)), " ").cast(kind)]
    parts.append(pa.array([whole(t) for t in texts.take(pa.array(rest)).to_pylist()], type=kind))
    return np.concatenate([plain, rest]), pa.concat_arrays(parts)


def blank_runs(text: str) -> list[str]:
    """Keys of a text with runs of blanks: each chunk without the blank that a lone one has."""
    runs = _RUNS.findall(text)
    return [r if i == 0 else r[1:] for i, r in enumerate(runs)]


def gather(flat: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the coded lists, and the end of each."""
    start = np.cumsum(size) - size
    n = size[codes]
    end = np.cumsum(n)
    at = np.repeat(start[codes] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
    return flat[at], end


class ByteBpe:
    """Token ids of texts by the tokenizers library, each distinct pre-token encoded once.

    The library's pre-tokenizer never joins text across a blank that follows or precedes
    another kind of character, so chunks are independent.  Texts with other blank runs or
    with the strings of special tokens are encoded whole.
    """

    MOST = 300_000  # chunks, and pre-tokens, that a worker remembers; frequent ones come early

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.seen, self.chunks = kept_between_tasks(path), kept_between_tasks(path + " chunks")
        self.pattern = regex.compile(PRETOKEN)
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([r"[\s\p{Z}\x0b\x1c-\x1f\x{85}] ([\s\p{Z}\x0b\x1c-\x1f\x{85}]|$)", *special])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as 32-bit numbers."""
        out = []
        seen = self.seen
        for p in self.pattern.findall(chunk):
            ids = seen.get(p)
            if ids is None:
                found = self.tok.model.tokenize(p.encode().decode("latin1").translate(self.letters))
                ids = array("I", [t.id for t in found]).tobytes()
                if len(seen) < self.MOST:
                    seen[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row numbers, ids, end of each row's ids)``, rows in the order of the numbers."""
        texts = pc.fill_null(texts, "")
        n_odd = int(pc.sum(pc.match_substring_regex(texts, self.odd)).as_py() or 0)
        rows, parts = split_at_blanks(texts, self.odd, lambda t: [t])
        vocab, codes, offs = coded(parts)
        first = offs[:-1]
        lists = []
        for v in vocab:
            known = self.chunks.get(v)
            if known is None:
                known = self._chunk(" " + v)
                if len(self.chunks) < self.MOST:
                    self.chunks[v] = known
            lists.append(known)
        plain = len(rows) - n_odd
        heads = [vocab[c] for c in codes[first]]
        lists += [self._chunk(h) for h in heads[:plain]]
        lists += [array("I", e.ids).tobytes() for e in self.tok.encode_batch(heads[plain:], add_special_tokens=False)]
        codes[first] = len(vocab) + np.arange(len(rows))
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 4
        flat = np.frombuffer(b"".join(lists), np.uint32)
        ids, end = gather(flat, size, codes)
        return rows, ids, end[offs[1:] - 1] if len(end) else np.zeros(0, np.int64)
