"""Substring dedup: word windows that an earlier document holds are removed, found by super-k-mer partitioning.

A window is `width` consecutive words. Its minimiser is the least hash among its runs of `m` words; neighbouring
windows that share a minimiser form a super-k-mer, a run of words that belongs to one bucket. Equal windows have equal
minimisers, so they meet in one bucket.

1. Every super-k-mer sends its minimiser, a 128-bit digest of its words, and its place: no text.
2. Minimisers that occur in one document alone are done with. Of super-k-mers with equal words, all but those of the
   smallest doc_id are duplicates as they are.
3. Where a minimiser has super-k-mers of different words, one of each travels as a packed string to the minimiser's
   bucket, where sorting the windows finds, exactly, which ones an earlier document has.
4. Buckets of very many different strings (the edges of a passage that a large share of all documents hold) are taken
   apart: their windows are dealt out by 128-bit digests, so that no task gets them all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.io import cut, stored
from metrolith.llm.text import LONG, by_size, lean, pieces

#: Strings of one minimiser that are sorted in one task.
MOST_IN_BUCKET = 512
# Odd multipliers of the rolling hashes: fixed values, any odd numbers would do.
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse; grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A polynomial hash of values[start:end] for every range, from one prefix sum."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def super_kmers(joined: list[bytes], width: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text index, minimiser, first window, windows, digest) of every super-k-mer of texts whose words one space joins."""
    none = np.zeros(0, np.int64)
    words = np.fromiter((j.count(b" ") + 1 if j else 0 for j in joined), np.int64, len(joined))
    keep = np.flatnonzero(words >= width)
    if not len(keep):
        return none, none, none, none, []
    words, whole = words[keep], b" ".join([joined[i] for i in keep])
    data = np.frombuffer(whole, np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    hashes = _ranges(data.astype(np.uint64), starts, ends, _BYTES)
    n = len(hashes)
    grams = _ranges(hashes, np.arange(n - m + 1), np.arange(m, n + 1), _WORDS)
    least = _least(grams, width - m + 1)  # of the window that starts at each word
    first_word = np.concatenate([[0], np.cumsum(words)])
    of = np.repeat(np.arange(len(keep)), words)[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + width <= first_word[of + 1])
    mini, of = least[valid], of[valid]
    new = np.concatenate([[True], (mini[1:] != mini[:-1]) | (of[1:] != of[:-1])])
    begin = np.flatnonzero(new)
    # Runs end after as many windows as can share one place of a minimiser.
    rank = np.arange(len(mini)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(mini)]])))
    begin = np.flatnonzero(rank % (width - m + 1) == 0)
    count = np.diff(np.concatenate([begin, [len(mini)]]))
    at = valid[begin]
    lo, hi = starts[at].tolist(), ends[at + count + width - 2].tolist()
    digests = [_digest(whole[a:b]) for a, b in zip(lo, hi)]
    return keep[of[begin]], mini[begin].view(np.int64), at - first_word[of[begin]], count, digests


def _joined(texts: list[bytes], width: int) -> Iterator[tuple[int, list[bytes], np.ndarray | None]]:
    """(first text, words joined by one space, first word of each): texts as they are, very long ones in pieces, one at a time."""
    yield 0, [b" ".join(t.split()) if len(t) <= LONG else b"" for t in texts], None
    for i, t in enumerate(texts):
        begin = 0
        for piece in pieces(t, width) if len(t) > LONG else ():
            words = piece.split()
            yield i, [b" ".join(words)], np.array([begin])
            begin += len(words) - width + 1


def _records(docs: DataFrame, width: int, m: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 2)):
            ids, keys, texts = batch.column(0), batch.column(1), [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for lo, some, begins in _joined(texts, width):
                of, mini, first, count, digests = super_kmers(some, width, m)
                take = pa.array(of + lo if begins is None else np.full(len(of), lo))
                first = first if begins is None else first + begins[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini), pa.array(digests, pa.binary()), ids.take(take), keys.take(take), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["mini", "sid", "doc_id", "rk", "first", "n"])

    return docs.mapInArrow(lean(run), "mini long, sid binary, doc_id long, rk long, first int, n int")


def _packed(asked: DataFrame, width: int) -> DataFrame:
    """The packed strings that are asked for, from (doc_id, text, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 1)):
            for doc, text, ask in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()
                out = [(a["mini"], a["sid"], a["n_sid"], doc, b" ".join(words[a["first"] : a["first"] + a["n"] + width - 1])) for a in ask]
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["mini", "sid", "n_sid", "low", "packed"])

    return asked.mapInArrow(lean(run), "mini long, sid binary, n_sid long, low long, packed binary")


def _windows(packed: bytes, width: int) -> list[bytes]:
    words = packed.split(b" ")
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    return [packed[starts[j] : starts[j + width - 1] + len(words[j + width - 1])] for j in range(len(words) - width + 1)]


_RANGES = "mini long, sid binary, lo int, hi int"


def _as_ranges(found: dict[tuple[int, bytes], list[int]]) -> pa.RecordBatch:
    """Window numbers as half-open ranges."""
    out = []
    for (mini, sid), js in found.items():
        js = np.unique(js)
        cuts = np.flatnonzero(np.diff(js) != 1)
        for lo, hi in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(js) - 1]])):
            out.append((mini, sid, int(js[lo]), int(js[hi]) + 1))
    columns = list(zip(*out)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], names=["mini", "sid", "lo", "hi"])


def _sorted_buckets(strings: DataFrame, width: int) -> DataFrame:
    """Windows that an earlier string of their bucket has, as ranges by string; whole buckets are in one task each."""

    def judged(bucket: list[tuple[bytes, int, bytes]], mini: int, found: dict) -> None:
        if len(bucket) < 2:
            return
        all_ = sorted((w, low, sid, j) for sid, low, packed in bucket for j, w in enumerate(_windows(packed, width)))
        of, least = None, 0
        for w, low, sid, j in all_:
            if w != of:
                of, least = w, low
            elif low > least:
                found.setdefault((mini, sid), []).append(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple[bytes, int, bytes]] = []
        of = None
        for batch in batches:
            found: dict = {}
            for mini, sid, low, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if mini != of and bucket:
                    judged(bucket, of, found)
                    bucket = []
                of = mini
                bucket.append((sid, low, packed))
            yield _as_ranges(found)
        found = {}
        if bucket:
            judged(bucket, of, found)
        yield _as_ranges(found)

    return strings.select("mini", "sid", "low", "packed").repartition("mini").sortWithinPartitions("mini").mapInArrow(lean(run), _RANGES)


def _dealt_windows(strings: DataFrame, width: int) -> DataFrame:
    """The same for strings of very large buckets, by window."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(_digest(w), low, mini, sid, j) for mini, sid, low, packed in zip(*(c.to_pylist() for c in batch.columns)) for j, w in enumerate(_windows(packed, width))]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))], names=["w", "low", "mini", "sid", "j"])

    w = stored(strings.select("mini", "sid", "low", "packed").mapInArrow(lean(explode), "w binary, low long, mini long, sid binary, j int"))
    least = cut(w.groupBy("w").agg(F.min("low").alias("least")))
    later = w.join(least, "w").where("low > least")
    return later.select("mini", "sid", F.col("j").alias("lo"), (F.col("j") + 1).alias("hi"))


def repeated_ranges(docs: DataFrame, width: int = 50, m: int = 10, most: int = MOST_IN_BUCKET) -> DataFrame:
    """(doc_id, rk, lo, hi): half-open ranges of words to remove, from docs of (doc_id, rk, text) without null doc_ids."""
    records = stored(_records(docs, width, m))
    shared = records.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("mini")
    records = stored(records.join(cut(shared), "mini"))
    kinds = cut(records.groupBy("mini", "sid").agg(F.min(F.struct("doc_id", "rk", "first", "n")).alias("rep")))
    kinds = kinds.select("mini", "sid", "rep", F.col("rep.doc_id").alias("low"))
    many = cut(kinds.groupBy("mini").agg(F.count("*").alias("n_sid")).where("n_sid > 1"))
    asked = kinds.join(many, "mini").select("mini", "sid", "n_sid", "rep.*")
    asked = asked.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("mini", "sid", "n_sid", "first", "n")).alias("asked"))
    strings = stored(_packed(docs.join(asked, ["doc_id", "rk"]).select("doc_id", "text", "asked"), width))
    found = _sorted_buckets(strings.where(F.col("n_sid") <= most), width)
    large = strings.where(F.col("n_sid") > most)
    if large.limit(1).count():
        found = found.union(_dealt_windows(large, width))
    found = stored(found)
    low = kinds.select("mini", "sid", "low")
    placed = records.join(low, ["mini", "sid"])
    copies = placed.where("doc_id > low").select("doc_id", "rk", F.col("first").alias("lo"), (F.col("first") + F.col("n") + width - 1).alias("hi"))
    own = placed.where("doc_id = low").join(found.withColumnRenamed("lo", "wlo").withColumnRenamed("hi", "whi"), ["mini", "sid"])
    own = own.select("doc_id", "rk", (F.col("first") + F.col("wlo")).alias("lo"), (F.col("first") + F.col("whi") + width - 1).alias("hi"))
    return copies.union(own)


def _kept(text: bytes, ranges: list[dict]) -> tuple[int, int, bytes]:
    """(words, words removed, what is left): a run of words goes with the white space up to the next word."""
    places = np.fromiter((x for w in _WORD.finditer(text) for x in w.span()), np.int64).reshape(-1, 2)
    n = len(places)
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, [r["lo"] for r in ranges], 1)
    np.add.at(drop, [r["hi"] for r in ranges], -1)
    gone = np.concatenate([[False], np.cumsum(drop[:-1]) > 0, [False]])
    begins, ends = np.flatnonzero(~gone[:-1] & gone[1:]), np.flatnonzero(gone[:-1] & ~gone[1:])
    left, at = [], 0
    for lo, hi in zip(begins.tolist(), ends.tolist()):
        left.append(text[at : places[lo, 0]])
        at = int(places[hi, 0]) if hi < n else len(text)
    return n, int(gone.sum()), b"".join([*left, text[at:]])


def dedup_substrings(docs: DataFrame, width: int = 50, m: int = 10, doc_id: str = "doc_id", text: str = "text", most: int = MOST_IN_BUCKET,
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of docs, and the columns named in `carry`.

    Words are runs of anything but ASCII white space. Every word is removed that is covered by a window of `width` words
    whose word sequence also starts in a document with a smaller doc_id; all windows are judged on the input. kept_text
    is the text without those words and without the white space after them: what stays keeps its lines and indentation.

    Null texts have no words (kept_text is then empty). Rows of one doc_id, such as repeated rows, are not earlier than
    each other. Rows with a null doc_id are kept whole and make nothing else a repeat. Texts under `width` words stay.
    Empty tables give empty results; other columns are ignored.
    """
    d = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("rk"), F.col(text).cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)],
    )
    carried = [f"carried_{i}" for i in range(len(carry))]
    known, unknown = d.where("doc_id is not null"), d.where("doc_id is null")
    ranges = repeated_ranges(known.select("doc_id", "rk", "text"), width, m, most)
    ranges = ranges.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 1)):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            out = [_kept(t, ranges) if ranges else (len(t.split()), 0, t) for t, ranges in zip(texts, batch.column(2).to_pylist())]
            columns = zip(*out) if out else [()] * 3
            made = [pa.array(c, type=k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:2], made[2].cast(pa.string()), *batch.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept_text", *carried])

    whole = known.join(ranges, ["doc_id", "rk"], "left").select("doc_id", "text", "ranges", *carried)
    whole = whole.union(unknown.select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>"), *carried))
    types = "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in carried)
    out = whole.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_text string" + types)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *[F.col(x).alias(c) for x, c in zip(carried, carry)])
