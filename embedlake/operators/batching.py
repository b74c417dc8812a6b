"""Request batches: runs of chunks within a provider's limits."""

from __future__ import annotations

from collections.abc import Sequence


class BatchingError(ValueError):
    """A single chunk is over the token limit of a request."""


def batch_indices(lengths: Sequence[float], max_chunks: int, max_tokens: float | None = None) -> list[tuple[int, int]]:
    """(start, end) of greedy batches of at most ``max_chunks`` chunks and ``max_tokens`` tokens."""
    out: list[tuple[int, int]] = []
    start, held = 0, 0
    for k, n in enumerate(lengths):
        if max_tokens is not None and n > max_tokens:
            raise BatchingError(f"chunk length {n} greater than max_tokens_per_batch {max_tokens}")
        if k > start and (k - start == max_chunks or (max_tokens is not None and held + n > max_tokens)):
            out.append((start, k))
            start, held = k, 0
        held += n
    if len(lengths) > start:
        out.append((start, len(lengths)))
    return out


def estimated_tokens(text: str) -> float:
    """A quarter of the UTF-8 bytes."""
    return len(text.encode()) * 0.25
