"""Text splitters, as functions on text, Arrow functions on columns, and table functions in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARACTER_SEPARATOR = "\n\n"
SEPARATORS = ("\n\n", "\n", ".", "?", "!", " ", "")
TABLE_SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str, regex: bool, keep: bool) -> list[str]:
    """Non-empty pieces of ``text``; with ``keep`` each separator stands at the start of the piece behind it."""
    if not separator:
        return list(text)
    out, last = [], 0
    for m in re.finditer(separator if regex else re.escape(separator), text):
        if m.end() == m.start():
            continue
        out.append(text[last : m.start()])
        last = m.start() if keep else m.end()
    out.append(text[last:])
    return [p for p in out if p]


def _merge(pieces: Sequence[str], glue: str, size: int, overlap: int) -> list[str]:
    """Greedy windows of pieces of at most ``size`` characters that share at most ``overlap``."""
    out: list[str] = []
    window: list[str] = []
    total = 0

    def flush() -> None:
        joined = glue.join(window).strip()
        if joined:
            out.append(joined)

    for p in pieces:
        n = len(p)
        if window and total + n + len(glue) > size:
            flush()
            while total > overlap or (total > 0 and total + n + (len(glue) if window else 0) > size):
                total -= len(window.pop(0)) + (len(glue) if window else 0)
        window.append(p)
        total += n + (len(glue) if len(window) > 1 else 0)
    flush()
    return out


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0:
        raise ValueError("chunk_size must be positive and chunk_overlap not negative")
    if overlap > size:
        raise ValueError(f"chunk_overlap {overlap} is larger than chunk_size {size}")


def split_character(text: str | None, size: int = 800, overlap: int = 400, separator: str = CHARACTER_SEPARATOR, regex: bool = False) -> list[str]:
    _check(size, overlap)
    return _merge(_pieces(text or "", separator, regex, False), "" if regex else separator, size, overlap)


def split_recursive(text: str | None, size: int = 800, overlap: int = 400, separators: Sequence[str] = SEPARATORS, regex: bool = False) -> list[str]:
    """Splits by the first separator that occurs; pieces that are still too long by those behind it."""
    _check(size, overlap)
    text = text or ""
    at = next((k for k, s in enumerate(separators) if s == "" or re.search(s if regex else re.escape(s), text)), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for p in _pieces(text, separators[at], regex, True):
        if len(p) < size:
            short.append(p)
            continue
        out += _merge(short, "", size, overlap)
        short = []
        out += split_recursive(p, size, overlap, rest, regex) if rest else [p]
    return out + _merge(short, "", size, overlap)


def splitter(kind: str, **options):
    """A function from text to chunks for a chunking implementation's name."""
    if kind == "none":
        return lambda text: [text or ""]
    size, overlap, regex = options.get("chunk_size", 800), options.get("chunk_overlap", 400), options.get("is_separator_regex", False)
    if kind == "character_text_splitter":
        return lambda text: split_character(text, size, overlap, options.get("separator", CHARACTER_SEPARATOR), regex)
    if kind == "recursive_character_text_splitter":
        return lambda text: split_recursive(text, size, overlap, options.get("separators", SEPARATORS), regex)
    raise ValueError("invalid chunking config implementation")


def chunks(text: Column | str, kind: str = "recursive_character_text_splitter", **options) -> Column:
    """An array of chunks of a text column."""
    column = F.col(text) if isinstance(text, str) else text
    if kind == "none":
        return F.array(F.coalesce(column, F.lit("")))
    split = splitter(kind, **options)

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([split(t.as_py()) for t in batch], pa.list_(pa.string()))

    return run(column)


def explode_chunks(df: DataFrame, text_col: str, kind: str = "recursive_character_text_splitter", **options) -> DataFrame:
    """A row per chunk, with chunk_seq (from 0) and chunk; rows without chunks go."""
    return df.select("*", F.posexplode(chunks(text_col, kind, **options)).alias("chunk_seq", "chunk"))


class ChunkText:
    """``ai_chunk_text(input, size, overlap, separator, regex)`` -> (seq, chunk)."""

    def eval(self, input: str, chunk_size: int = 4000, chunk_overlap: int = 200, separator: str = "\n\n", is_separator_regex: bool = False):
        for k, c in enumerate(split_character(input, chunk_size or 4000, 200 if chunk_overlap is None else chunk_overlap, "\n\n" if separator is None else separator, bool(is_separator_regex))):
            yield k, c


class ChunkTextRecursively:
    """``ai_chunk_text_recursively(input, size, overlap, separators, regex)`` -> (seq, chunk)."""

    def eval(self, input: str, chunk_size: int = 4000, chunk_overlap: int = 200, separators: list = None, is_separator_regex: bool = False):
        for k, c in enumerate(split_recursive(input, chunk_size or 4000, 200 if chunk_overlap is None else chunk_overlap, tuple(separators or TABLE_SEPARATORS), bool(is_separator_regex))):
            yield k, c


def table_functions() -> dict:
    """The table functions, to be registered for SQL."""
    return {f"ai_{name}": F.udtf(cls, returnType="seq int, chunk string") for name, cls in (("chunk_text", ChunkText), ("chunk_text_recursively", ChunkTextRecursively))}
