"""Tokenising by distinct segments.

Texts are cut where no tokeniser in use can join what stands on both sides, each distinct segment is
encoded once per Python worker, and texts are put together from the results. Equal to encoding whole
texts; the cuts are proved at ``cuts_bpe`` and ``cuts_piece``.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np

from embedlake.llm import _text as T

#: Bytes of the table of encoded segments that a worker keeps; beyond it the table starts anew.
KEEP_BYTES = 16 << 20
#: Text bytes handled at once.
SLICE = 2 << 20


def cuts_bpe(data: np.ndarray) -> np.ndarray:
    """Where a match of the byte-level pattern must start, whatever stands around.

    Every alternative of the pattern is either all white space, or holds white space (one blank) only as
    its first character. So white space after a character that is none always starts a match. Bytes that
    may end a white-space character beyond ASCII are left alone, as are the control characters 0x1C-0x1F.
    """
    cut = T.SPACE[data]
    if len(data) < 2:
        return cut & False
    prev = np.empty_like(data)
    prev[0], prev[1:] = 0x20, data[:-1]
    second = np.empty_like(data)
    second[:2], second[2:] = 0, data[:-2]
    odd = (prev >= 0x80) & ((second == 0xC2) | (second == 0x80) | (second == 0x81) | (second == 0x9A))
    return cut & ~T.SPACE[prev] & ~odd & ~((prev >= 0x1C) & (prev <= 0x1F))


def cuts_piece(data: np.ndarray) -> np.ndarray:
    """A single blank between two characters that are none, for models whose pieces hold the blank mark only in front."""
    if len(data) < 3:
        return np.zeros(len(data), bool)
    blank = data == 0x20
    out = blank.copy()
    out[0] = out[-1] = False
    out[1:] &= ~blank[:-1] & (data[:-1] != 0x81)
    out[:-1] &= ~blank[1:] & (data[1:] != 0xE2)
    return out


class _Grown:
    """An array that grows at its end; its room doubles."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            data = np.zeros(max(2 * len(self.data), self.n + len(more)), self.data.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Coder:
    """``encode`` gets a list of distinct strings and gives a list of id lists (or of counts)."""

    def __init__(self, encode: Callable[[list[str]], list], cuts: Callable, drop_blank: bool = False, counts: bool = False):
        self.encode, self.cuts, self.drop_blank, self.counts = encode, cuts, drop_blank, counts
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and where their segment's entry is
        self.size, self.start, self.ids = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32)

    def bytes(self) -> int:
        return self.keys.nbytes + self.at.nbytes + sum(x.n * x.data.itemsize for x in (self.size, self.start, self.ids))

    def _segments(self, data: np.ndarray, offsets: np.ndarray):
        cut = self.cuts(data)
        begin = T._starts(offsets)
        if self.drop_blank:  # a row's last byte is no blank between two characters
            cut[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
        cut[begin] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if self.drop_blank:
            lead = np.ones(len(starts), np.int64)
            lead[np.searchsorted(starts, begin)] = 0
            return starts, starts + lead, ends
        return starts, starts, ends

    def _index(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        key, first, back = np.unique(T.hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == key
        found = np.empty(len(key), np.int64)
        found[known] = self.at[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw, s, e = data.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            got = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e, strict=True)])
            base = self.size.n
            if self.counts:
                size = np.array(got, np.int64)
            else:
                size = np.fromiter(map(len, got), np.int64, len(got))
                self.start.add(self.ids.n + np.cumsum(size) - size)
                self.ids.add(np.fromiter((i for g in got for i in g), np.uint32, int(size.sum())))
            self.size.add(size)
            found[new] = np.arange(base, base + len(new))
            self.keys, self.at = np.insert(self.keys, place[new], key[new]), np.insert(self.at, place[new], found[new])
        return found[back]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        total = np.zeros(len(offsets), np.int64)
        if len(data):
            if self.bytes() > KEEP_BYTES:
                self.clear()
            starts, inner, ends = self._segments(data, offsets)
            seg = self._index(data, inner, ends)
            run = np.append(0, np.cumsum(self.size.data[seg]))
            total = run[np.searchsorted(starts, offsets)]
        return np.diff(total)

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin (with a closing entry)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.bytes() > KEEP_BYTES:
            self.clear()
        starts, inner, ends = self._segments(data, offsets)
        seg = self._index(data, inner, ends)
        size = self.size.data[seg]
        run = np.append(0, np.cumsum(size))
        where = np.repeat(self.start.data[seg] - run[:-1], size) + np.arange(run[-1])
        return self.ids.data[where], run[np.searchsorted(starts, offsets)]


_kept: dict[tuple, Coder] = {}


def coder(kind: str, path: str) -> Coder:
    """The worker's coder for a tokeniser file; kept between tasks of a Python worker.

    ``kind``: "tokenizers" (ids), "tiktoken" (ids) or "sentencepiece" (counts).
    """
    if (kind, path) not in _kept:
        _kept[kind, path] = {"tokenizers": _tokenizers, "tiktoken": _tiktoken, "sentencepiece": _sentencepiece}[kind](path)
    return _kept[kind, path]


def _tokenizers(path: str) -> Coder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    slow = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    fast = _as_ranks(path)
    if fast is None:
        return Coder(slow, lambda data: np.zeros(len(data), bool))
    one, added = fast

    def encode(texts: list[str]) -> list[list[int]]:
        odd = [k for k, x in enumerate(texts) if any(a in x for a in added)]
        out = [one(x) for x in texts]
        for k, ids in zip(odd, slow([texts[k] for k in odd]) if odd else [], strict=True):
            out[k] = ids
        return out

    return Coder(encode, cuts_bpe)


def _as_ranks(path: str):
    """(encode, added strings) if the file is plain byte-level BPE whose merges stand in the order of their ids, else None.

    Such a file gives the ids of the rank encoder, which is several times faster on short segments. Segments
    that hold an added token go to the library itself.
    """
    import json

    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    added = [a["content"] for a in spec.get("added_tokens", [])]
    if not plain or any(T.SPACE[b] for a in added for b in a.encode()) or any(a.get("lstrip") or a.get("rstrip") for a in spec.get("added_tokens", [])):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab.get(a + b, -1) for a, b in pairs]
    if order != sorted(order) or len(set(order)) != len(order):
        return None
    ranks = {bytes(back[c] for c in k): v for k, v in vocab.items() if k not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, added


@functools.lru_cache(maxsize=1)
def encoding(path: str):
    """The tiktoken encoding of a rank file, with the public pattern and no special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tiktoken(path: str) -> Coder:
    one = encoding(path).encode_ordinary
    return Coder(lambda texts: [one(x) for x in texts], cuts_bpe)


def _sentencepiece(path: str) -> Coder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    safe = not any("▁" in p.lstrip("▁") for p in pieces)  # else only whole texts are safe
    none = lambda data: np.zeros(len(data), bool)
    return Coder(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], cuts_piece if safe else none, drop_blank=True, counts=True)
