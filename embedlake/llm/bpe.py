"""Operator 6: byte-level BPE encoding and decoding by monoid tree reduction.

A text longer than a leaf is halved until its parts are leaves. Leaves are encoded on their own. Two
neighbours are joined by encoding a window around the seam anew: the window grows until each end is the
node's own end or a place where a match of the pattern starts whatever stands around it. Matches do not
cross such a place and BPE works within a match, so tokens outside the window are those of the joined text
and the result does not depend on where the text was halved. Decoding joins the bytes of leaves up the tree.

Cases: null or empty text has no ids; null document ids are kept; repeated rows are encoded each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embedlake.llm import _segments as S
from embedlake.llm import _text as T

#: Bytes of text, and ids, of a leaf.
LEAF_BYTES, LEAF_IDS = 1024, 4096


class Tree:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, leaf_bytes: int = LEAF_BYTES):
        self.coder, self.encoding, self.leaf = S.coder("tiktoken", path), S.encoding(path), max(leaf_bytes, 8)  # one encoding, kept by path
        size = np.zeros(self.encoding.n_vocab, np.int64)
        for token in self.encoding.token_byte_values():
            size[self.encoding.encode_single_token(token)] = len(token)
        self.size = size

    def _halves(self, data: np.ndarray, a: int, b: int, out: list[int]) -> object:
        """Leaves of [a, b) go to ``out``; returns their tree, with leaves as numbers."""
        if b - a <= self.leaf:
            out.append(a)
            return len(out) - 1
        mid = (a + b) // 2
        while (data[mid] & 0xC0) == 0x80:
            mid += 1
        if mid >= b:
            out.append(a)
            return len(out) - 1
        return self._halves(data, a, mid, out), self._halves(data, mid, b, out)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row."""
        leaves: list[int] = []
        trees = [self._halves(data, int(a), int(b), leaves) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        bounds = np.array([*leaves, len(data)], np.int64)
        ids, begin = self.coder.tokens(data, bounds)
        cut = S.cuts_bpe(data) if len(leaves) > len(trees) else None

        def reduce(tree: object) -> tuple[np.ndarray, int, int]:
            if isinstance(tree, int):
                return ids[begin[tree] : begin[tree + 1]], int(bounds[tree]), int(bounds[tree + 1])
            return self.join(data, cut, reduce(tree[0]), reduce(tree[1]))

        return [reduce(t)[0] for t in trees]

    def join(self, data: np.ndarray, cut: np.ndarray, left: tuple, right: tuple) -> tuple[np.ndarray, int, int]:
        (x, start, mid), (y, _, end) = left, right
        if start == mid or mid == end:
            return np.append(x, y), start, end
        p = q = None
        width = 32
        while p is None or q is None:
            if p is None:
                lo = max(start, mid - width)
                inner = np.flatnonzero(cut[lo + (lo > start) : mid])
                # a start seen from both sides: neither the seam itself nor the node's first byte counts
                p = int(inner[-1]) + lo + (lo > start) if len(inner) else start if lo == start else None
            if q is None:
                hi = min(end, mid + width)
                inner = np.flatnonzero(cut[mid + 1 : hi])
                q = int(inner[0]) + mid + 1 if len(inner) else end if hi == end else None
            width *= 2
        window = self.encoding.encode_ordinary(data[p:q].tobytes().decode("utf-8", "replace"))
        drop = self._tokens_in(x[::-1][: mid - p], mid - p)
        skip = self._tokens_in(y[: q - mid], q - mid)
        return np.concatenate([x[: len(x) - drop], np.array(window, np.uint32), y[skip:]]), start, end

    def _tokens_in(self, ids: np.ndarray, n_bytes: int) -> int:
        if not n_bytes:
            return 0
        run = np.cumsum(self.size[ids])
        at = int(np.searchsorted(run, n_bytes))
        if at >= len(run) or run[at] != n_bytes:
            raise AssertionError("a token crosses a place where a match starts")
        return at + 1

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.encoding.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_trees: dict[str, Tree] = {}


def tree(path: str) -> Tree:
    if path not in _trees:
        _trees[path] = Tree(path)
    return _trees[path]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of int) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(1), S.SLICE):
                ids = [x.astype(np.int32) for x in tree(ranks).encode(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the bytes (``decoded``) of each list of ids; a null list has no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [tree(ranks).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding fused, so that no ids leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree(ranks)
        decimal = [str(i) for i in range(t.encoding.n_vocab)].__getitem__
        for batch in batches:
            for a, b, data, offsets in T.slices(batch.column(1), S.SLICE):
                n, of_ids, of_bytes = [], [], []
                for ids in map(np.ndarray.tolist, t.encode(data, offsets)):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(t.decode(ids)).hexdigest())
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
