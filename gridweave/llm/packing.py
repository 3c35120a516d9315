"""Packing documents into sequences: shortest-pack-first over the length histogram.

Every document is encoded whole and ended with one end id. Pieces of exactly the sequence's
length are cut from its front and fill sequences of their own; what is left of it is one
shorter piece. The histogram of those lengths (at most ``limit`` entries) goes to the driver,
which places lengths longest first, each into the shortest pack there is (the one with the most
room), or into a new one if it doesn't fit there, and updates counts of packing patterns instead of packs. The
pieces are joined back to the patterns by their rank among pieces of the same length.

The rank needs no sort: pieces are numbered within each task while they are written, and a
table of counts by task and length gives what comes before; it is broadcast while it is small.

A null text counts as empty: one piece with the end id alone. Repeated rows and equal doc_ids
are packed as separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, give_back, in_batches, stash
from .tokens import default_tokenizer, encoder

END = b"\0\0\0\0"
#: Rows (task, length) of the table of counts up to which it is broadcast: 24 MB; else it is joined by a shuffle.
FEW_COUNTS = 1_000_000


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        tok = encoder(path)
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tok.encode_batch(b.column("text"))):
                ids += END
                total = len(ids) // 4
                for start in range(0, total, limit):
                    part = ids[4 * start : 4 * (start + limit)]
                    n = len(part) // 4
                    out.append((task, seen[n], doc_id, start, n, zlib.crc32(part), total))
                    seen[n] += 1
            columns = list(zip(*out)) or [[]] * 7
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["task", "turn", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_histogram(counts: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: (times, lengths) of every packing pattern, over a histogram.

    A length goes into the shortest pack, which has the most room; where it doesn't fit there it fits
    nowhere, and a new pack is begun, which is then the shortest one and takes as many of that length
    as fit. A pattern is split when only some of its packs take the length. Deterministic.
    """
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []  # sorted, of patterns with room

    def put(times: int, lengths: tuple[int, ...], room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([times, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = rooms[-1] if rooms else 0
            if fit < length:
                most = limit // length
                for times, held in ((left // most, most), (1, left % most)):
                    if times and held:
                        put(times, (length,) * held, limit - held * length)
                break
            times, lengths = by_room[fit].pop()
            if not by_room[fit]:
                del by_room[fit]
                rooms.pop()
            used = min(times, left)
            if times > used:
                put(times - used, lengths, fit)
            put(used, (*lengths, length), fit - length)
            left -= used
    return sorted((times, lengths) for group in by_room.values() for times, lengths in group)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, where its ranks go: first rank, sequence of that rank, offset there.

    A length that a pattern holds twice has two entries.
    """
    rank: Counter[int] = Counter()
    rows: dict[int, list] = {}
    first = 0
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            rows.setdefault(n, []).append((rank[n], first, offset))
            rank[n] += times
            offset += n
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("turn").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                start, first, at = held[n]
                k = np.searchsorted(start, rank[own], side="right") - 1
                sequence[own], offset[own] = first[k] + rank[own] - start[k], at[k]
            keep = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, limit: int = 1024, tokenizer: str | None = None, scope: str = "default") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    columns = "task long, turn long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stash(documents(docs).transform(in_batches, _pieces(tokenizer or default_tokenizer(), limit), columns), "pieces", scope)
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    table = spark.sparkContext.broadcast(slots(pack_histogram(histogram, limit)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = stash(counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "pieces-before", scope)
    ranked = pieces.join(F.broadcast(before) if before.count() <= FEW_COUNTS else before, ["task", "length"])
    return ranked.transform(in_batches, _place(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
