"""What the text operators share: words, pieces of batches and of very long texts, and lean Python workers."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of code points other than ASCII white space. In Python, bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text that are worked on at a time, and beyond which a single text is cut into pieces.
SLICE, LONG = 2 << 20, 1 << 20


def word_count(text: Column | str) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def by_size(batch: pa.RecordBatch, column: int, most_bytes: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about most_bytes of a text column, one row at least; an empty batch gives itself."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def pieces(text: bytes, k: int, most_bytes: int = LONG) -> Iterator[bytes]:
    """A text in pieces that hold each run of k consecutive words exactly once; a text of fewer words is one piece.

    Pieces after the first begin with the k - 1 words before them.
    """
    if len(text) <= most_bytes:
        yield text
        return
    before, at, made = b"", 0, False
    while at < len(text):
        space = _SPACE.search(text, at + most_bytes)
        end = space.start() if space else len(text)
        piece = before + b" " + text[at:end]
        last = piece.rsplit(None, k - 1)
        if len(last) < k:
            before = piece
        else:
            yield piece
            before, made = b" ".join(last[1:]), True
        at = end
    if not made:
        yield before


def in_pieces(texts: list[bytes], k: int) -> tuple[list[bytes], np.ndarray]:
    """pieces() of all texts, and the index of the text that each belongs to."""
    if all(len(t) <= LONG for t in texts):
        return texts, np.arange(len(texts))
    found = [(i, p) for i, t in enumerate(texts) for p in pieces(t, k)]
    return [p for _, p in found], np.array([i for i, _ in found])


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim, _libc.mallopt  # noqa: B018
except (OSError, AttributeError):  # another C library: memory goes back when it likes
    _libc = None
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1  # fixed values of mallopt()


def _keep_lean() -> None:
    pa.set_memory_pool(pa.system_memory_pool())
    if _libc is not None:
        _libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
        _libc.mallopt(_TRIM_THRESHOLD, 8 << 20)


def _give_back() -> None:
    gc.collect()
    if _libc is not None:
        _libc.malloc_trim(0)


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives freed memory back to the system: workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_lean()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow on groups."""

    def wrapped(rows: pa.Table) -> pa.Table:
        _keep_lean()
        try:
            return run(rows)
        finally:
            _give_back()

    return wrapped


def lean_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for applyInArrow on cogroups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        _keep_lean()
        try:
            return run(left, right)
        finally:
            _give_back()

    return wrapped
