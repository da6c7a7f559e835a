"""Best-fit packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.llm.text import by_size, lean
from metrolith.llm.tokens import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that are packed together. Each group leaves at most a few sequences part empty; more cost time by the square.
GROUP = 8192


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then end_id.

    Documents over the capacity are cut into pieces of the capacity; the first piece takes the rest. Null and empty
    texts have the end id alone. Every row has pieces of its own, repeated rows and null doc_ids too.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(tokenizer_path), np.uint32(end_id).tobytes()
        for batch in (b for whole in batches for b in by_size(whole, 1)):
            out: list[tuple] = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(t or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    part = ids[4 * at : 4 * (at + size)]
                    out.append((key, k, at, size, zlib.crc32(part), *([part] if keep_ids else [])))
                    at, k = at + size, k + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, types)], names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(lean(cut_up), schema)


def best_fit(lengths: np.ndarray, capacity: int, most_documents: int, most_cost: float,
             weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by decreasing length.

    A bin has three residual capacities: tokens, documents, and attention cost (the sum of squared lengths). An item
    goes to a bin that holds it in every one: with rule "norm", to that whose weighted residual norm afterwards is
    least; with "dot", to that whose residual has the largest weighted dot product with the item. Else a bin opens.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    tokens, documents, cost = np.empty(n), np.empty(n), np.empty(n)
    ids = np.empty(n, np.int64)
    open_, made = 0, 0
    wt, wd, wc = weights[0] / capacity**2, weights[1] / most_documents**2, weights[2] / most_cost**2
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        own = float(size) * size
        t, d, c = tokens[:open_], documents[:open_], cost[:open_]
        fits = np.flatnonzero((t >= size) & (d >= 1) & (c >= own))
        if len(fits):
            if rule == "norm":
                score = wt * (t[fits] - size) ** 2 + wd * (d[fits] - 1) ** 2 + wc * (c[fits] - own) ** 2
                j = fits[np.argmin(score)]
            else:
                j = fits[np.argmax(wt * t[fits] * size + wd * d[fits] + wc * c[fits] * own)]
        else:
            j = open_
            tokens[j], documents[j], cost[j], ids[j] = capacity, most_documents, most_cost, made
            open_, made = open_ + 1, made + 1
        bins[i], offsets[i] = ids[j], capacity - tokens[j]
        tokens[j] -= size
        documents[j] -= 1
        cost[j] -= own
        if tokens[j] < 1 or documents[j] < 1 or cost[j] < 1:  # full: the last open bin takes its place
            open_ -= 1
            for a in (tokens, documents, cost, ids):
                a[j] = a[open_]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, most_documents: int = 2048, most_cost: float | None = None,
         weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset; every column of `pieces` stays.

    Pieces are dealt out by hash, and each task packs them in groups of at most GROUP: memory is bounded, no group
    depends on another, and a lost task is packed again alone, in the same groups. Sequence ids are unique, not gapless.
    Pieces of the full capacity, longer ones, and pieces that alone cost more than most_cost are sequences of their own.
    An empty table gives an empty result.
    """
    cost_limit = float(capacity) ** 2 if most_cost is None else float(most_cost)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, rows = TaskContext.get().partitionId() << 36, [], 0
        made = 0

        def packed(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(group).combine_chunks()
            lengths = t.column(at).to_numpy()
            bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            full = (lengths >= capacity) | (lengths.astype(np.float64) ** 2 > cost_limit)
            bins[full] = np.arange(full.sum())
            bins[~full], offsets[~full] = best_fit(lengths[~full], capacity, most_documents, cost_limit, weights, rule)
            bins[~full] += full.sum()
            first = base + made
            made += int(bins.max()) + 1
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(bins + first), pa.array(offsets)], names=[*t.column_names, "sequence_id", "offset"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, GROUP - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == GROUP:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    # Sorted, a task that runs again groups its pieces as before, in whatever order they come; equal rows are alike.
    dealt = pieces.repartition(F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInArrow(lean(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, document_starts) from pieces that were packed with their ids."""
    s = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return s.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["offset"]).alias("document_starts"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): token_pieces(), packed.

    Null and empty texts are the end id alone. Texts over the capacity are cut, the first piece being the shorter. Ties
    between sequences go to the one opened first. Repeated rows and rows with null ids are packed each. An empty table
    gives an empty result; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), capacity, **limits)
