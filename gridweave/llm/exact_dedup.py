"""Exact dedup with a log-structured merge index.

Every task fills a memtable keyed by the SHA-256 digest of the normalised text and flushes it
as a sorted run. A run's first row carries its footer: the last digest and two Bloom filters, of all its
digests and of those with several rows. Compaction merges runs of any level by digest range: entries are
range-partitioned and sorted (an external merge), and of each digest the entry of the best row, with the
smallest identifier among equals, stays; the runs of the result have disjoint ranges. Lookups probe the
filters of the runs whose range holds a digest: rows that no filter lets through have no copy and are
never shuffled. Hits receive byte verification: their normalised texts are grouped by the bytes
themselves, so that a digest collision can never merge two texts.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Of
equal texts the row with the most code points in the original stays, then the smallest doc_id
(null last), then the row read first, so exactly one of repeated rows stays.
Null text counts as empty. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, documents, group_bounds, in_batches, least_partitions, stash, whole_groups
from .members import MOST_BITS, filter_of, member_filter, passes

#: Entries that a memtable holds before it is flushed.
MEMTABLE_ROWS = 200_000
#: A digest with this share of all rows is joined without a shuffle; there are at most 1 / HOT.
HOT = 1e-3
_ENTRY = ("digest", "points", "keep_id", "keep_row", "n")
_FOOTER = pa.struct([("last", pa.binary()), ("filter", pa.binary()), ("hits", pa.binary())])
_RUN = "digest binary, points long, keep_id long, keep_row long, n long, footer struct<last: binary, filter: binary, hits: binary>"


def _digest(text: bytes | None, size: int) -> tuple[bytes, bytes]:
    norm = (text or b"").translate(None, ASCII_SPACE)
    return hashlib.sha256(norm).digest()[:size], norm


def _code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            out, points = [], []
            for t in texts:
                out.append(_digest(t, size)[0])
                points.append(_code_points(t or b""))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(out, pa.binary()), pa.array(points, pa.int64())], names=["row", "doc_id", "digest", "points"])

    return run


def _rank(points: int, doc_id: int | None, row: int) -> tuple:
    return (-points, doc_id is None, doc_id or 0, row)


def _keys(digests: list[bytes]) -> np.ndarray:
    """What xxhash64() gives of the digests."""
    return np.fromiter((xxhash.xxh64_intdigest(d, 42) for d in digests), np.uint64, len(digests))


def _run(digests: list[bytes], points: pa.Array, keep_id: pa.Array, keep_row: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """A sorted run with its footer. ``hits`` is null where no digest has several rows."""
    keys = _keys(digests)
    footer = {"last": digests[-1], "filter": filter_of(keys), "hits": filter_of(keys[n > 1]) if (n > 1).any() else None}
    footers = pa.concat_arrays([pa.array([footer], _FOOTER), pa.nulls(len(digests) - 1, _FOOTER)])
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), points, keep_id, keep_row, pa.array(n), footers], names=[*_ENTRY, "footer"])


def _flush(table: dict[bytes, list]) -> pa.RecordBatch:
    keys = sorted(table)
    best = [table[k][0] for k in keys]
    ids = pa.array([None if x[1] else x[2] for x in best], pa.int64())
    return _run(keys, pa.array([-x[0] for x in best], pa.int64()), ids, pa.array([x[3] for x in best], pa.int64()), np.array([table[k][1] for k in keys], np.int64))


def _memtables(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        for b in batches:
            for row, doc_id, digest, points in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "digest", "points"))):
                own = _rank(points, doc_id, row)
                held = table.get(digest)
                if held is None:
                    table[digest] = [own, 1]
                    if len(table) >= limit:
                        yield _flush(table)
                        table = {}
                else:
                    held[0] = min(held[0], own)
                    held[1] += 1
        if table:
            yield _flush(table)

    return run


def flush_runs(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS, scope: str = "default") -> DataFrame:
    """Level 0: sorted runs of (digest, points, keep_id, keep_row, n) with their footers."""
    return stash(rows.transform(in_batches, _memtables(memtable_rows), _RUN), "lsm-level0", scope)


def _merged(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("digest",), limit):
            cuts = group_bounds(table, ("digest",))
            best = table.take(pa.array(cuts[:-1])).combine_chunks()
            n = np.add.reduceat(table.column("n").to_numpy(), cuts[:-1])
            yield _run(best.column("digest").to_pylist(), *(best.column(c).combine_chunks() for c in _ENTRY[1:4]), n)

    return run


def compact(runs: DataFrame, run_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Merge runs of any level into runs of disjoint digest ranges: one entry a digest, with the best row
    and the number of rows. A later batch is added by merging its runs with these."""
    entries = runs.select(*_ENTRY)
    ranges = max(least_partitions(runs.sparkSession), math.ceil(entries.count() / run_rows))
    order = ("digest", F.desc("points"), F.asc_nulls_last("keep_id"), "keep_row")
    return entries.repartitionByRange(ranges, "digest").sortWithinPartitions(*order).transform(in_batches, _merged(run_rows), _RUN)


class RunFilters:
    """The filters of some runs, by their ranges, for the driver to broadcast."""

    def __init__(self, runs: list[tuple[bytes, bytes, bytes]]):
        self.runs = [(bytes(low), bytes(last), np.frombuffer(words, np.uint32) if words else None) for low, last, words in runs]

    def passing(self, digests: list[bytes]) -> np.ndarray:
        """Which digests a run may hold."""
        order = sorted(range(len(digests)), key=digests.__getitem__)
        ranked = [digests[i] for i in order]
        keys = _keys(ranked)
        found = np.zeros(len(digests), bool)
        for low, last, words in self.runs:
            a, b = bisect_left(ranked, low), bisect_right(ranked, last)
            if a < b:
                found[a:b] |= passes(words, keys[a:b])
        out = np.zeros(len(digests), bool)
        out[order] = found
        return out


def run_filters(index: DataFrame, kind: str) -> RunFilters | None:
    """The filters (``filter`` or ``hits``) of an index's runs; None where they have more than 2**MOST_BITS bits
    together: all rows pass then, and the shuffled join does it."""
    held = index.where(F.col(f"footer.{kind}").isNotNull()).select("digest", "footer.last", F.col(f"footer.{kind}").alias("words"))
    size = held.agg(F.sum(F.length("words") + 128)).first()[0] or 0
    return RunFilters([tuple(r) for r in held.collect()]) if 8 * size <= 1 << MOST_BITS else None


def _passing(filters: RunFilters | None, digests: list[bytes]) -> np.ndarray:
    return np.ones(len(digests), bool) if filters is None else filters.passing(digests)


def _marked(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = _passing(filters.value, b.column("digest").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*b.schema.names, "hit"])

    return run


def _hit_rows(filters, size: int, others: bool = False):
    """Rows whose digest the filters let through, with the normalised text; others too if asked for, without digest and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            if not texts:
                continue
            digests, norms = zip(*(_digest(t, size) for t in texts))
            hit = _passing(filters.value, digests)
            at = range(len(texts)) if others else np.flatnonzero(hit)
            some = pa.array(at, pa.int64())
            points = pa.array([_code_points(texts[i] or b"") for i in at], pa.int64())
            found = [pa.array([x[i] if hit[i] else None for i in at], pa.binary()) for x in (digests, norms)]
            yield pa.RecordBatch.from_arrays([b.column("row").take(some), b.column("doc_id").take(some), found[0], points, found[1]], names=["row", "doc_id", "digest", "points", "norm"])

    return run


#: Columns of _hit_rows().
_HIT = "row long, doc_id long, digest binary, points long, norm binary"


class _Member:
    """A filter of members.py in the place of run filters."""

    def __init__(self, words: np.ndarray | None):
        self.words = words

    def passing(self, digests: list[bytes]) -> np.ndarray:
        return passes(self.words, _keys(digests))


def _indexed(source: DataFrame, memtable_rows: int, digest_bytes: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """The digests of all rows, and their compacted index."""
    rows = stash(source.transform(in_batches, _digests(digest_bytes), "row long, doc_id long, digest binary, points long"), "lsm-rows", scope)
    return rows, stash(compact(flush_runs(rows, memtable_rows, scope), memtable_rows), "lsm-level1", scope)


def exact_dedup(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest_bytes: int = 32, scope: str = "default") -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, digest.

    ``digest_bytes`` below 32 makes collisions likely; the byte verification then still gives
    exact groups (tests use that), only ``digest`` is the shortened one.
    """
    spark = docs.sparkSession
    source = documents(docs).withColumn("row", F.monotonically_increasing_id())
    rows, index = _indexed(source, memtable_rows, digest_bytes, scope)
    filters = spark.sparkContext.broadcast(run_filters(index, "hits"))
    texts = source.transform(in_batches, _hit_rows(filters, digest_bytes), _HIT)
    # Grouping by the bytes is the verification; copies collapse before the shuffle.
    verified = texts.groupBy("digest", "norm").agg(F.count("*").alias("copies"))
    collisions = stash(verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "lsm-collisions", scope)
    marked = rows.drop("points").transform(in_batches, _marked(filters), "row long, doc_id long, digest binary, hit boolean")
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True))
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id")
    columns = ("doc_id", keep_id, F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "digest")
    hits = index.where("n > 1").select("digest", "keep_id", "keep_row", "n")
    least = max(2.0, HOT * (index.agg(F.sum("n")).first()[0] or 0))
    hot = marked.where("hit").join(F.broadcast(hits.where(F.col("n") >= least)), "digest", "left")
    cold = hot.where("n is null").select("row", "doc_id", "digest").join(hits.where(F.col("n") < least), "digest", "left")
    single = marked.where("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    joined = hot.where("n is not null").select(*columns).unionByName(cold.select(*columns)).unionByName(single)
    if collisions.isEmpty():
        return joined
    # Rows under a digest that holds several texts are grouped by the texts themselves.
    apart = stash(texts.join(collisions, "digest", "left_semi"), "lsm-apart", scope)
    split = compact(apart.select(F.unhex(F.sha2("norm", 512)).alias("digest"), "points", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n")))
    split = split.drop("points", "footer").withColumnRenamed("digest", "full")
    exact = apart.withColumn("full", F.unhex(F.sha2("norm", 512))).drop("points").join(split, "full")
    return joined.join(collisions, "digest", "left_anti").unionByName(exact.select(*columns))


def build_index(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest_bytes: int = 32, scope: str = "default") -> DataFrame:
    """The compacted index of a table, for seen_before() and for compact() with the runs of later ones."""
    return _indexed(documents(docs).withColumn("row", F.monotonically_increasing_id()), memtable_rows, digest_bytes, scope)[1]


def seen_before(index: DataFrame, known: DataFrame, docs: DataFrame, digest_bytes: int = 32, scope: str = "default") -> DataFrame:
    """Every row of a later batch with the row of ``known``, the documents that ``index`` is of, that has an equal
    text: doc_id, seen, known_id (that stays in known; null if not seen, or if that doc_id is null).

    Rows that no run's filter lets through are new and not shuffled; hits are compared by their bytes."""
    spark = docs.sparkSession
    source = documents(docs).withColumn("row", F.monotonically_increasing_id())
    filters = spark.sparkContext.broadcast(run_filters(index, "filter"))
    batch = stash(source.transform(in_batches, _hit_rows(filters, digest_bytes, others=True), _HIT).drop("points"), "lsm-batch", scope)
    passed = batch.where("digest is not null")
    asked = stash(passed.select("digest", "norm").distinct().join(index.select("digest"), "digest", "left_semi"), "lsm-asked", scope)
    of_hits = spark.sparkContext.broadcast(_Member(member_filter(asked.select(F.xxhash64("digest")))))
    old = documents(known).withColumn("row", F.monotonically_increasing_id()).transform(in_batches, _hit_rows(of_hits, digest_bytes), _HIT)
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))).alias("b")
    equal = old.groupBy("digest", "norm").agg(best).join(asked, ["digest", "norm"]).select("digest", "norm", F.col("b.i").alias("known_id"), F.lit(True).alias("seen"))
    found = passed.join(equal, ["digest", "norm"]).select("row", "seen", "known_id")
    return batch.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("seen", F.lit(False)).alias("seen"), "known_id")
