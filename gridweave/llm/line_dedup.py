"""Line dedup by winnowing over line hashes.

Lines are hashed (blank ones are passed over), runs of ``run`` line hashes make grams, and of
every ``window`` consecutive grams the least (rightmost of equals) is a fingerprint. So any
``run + window - 1`` lines that repeat share a fingerprint. Each fingerprint is joined with its
first occurrence (by doc_id, null last, then position), the match is extended both ways line by
line, and the lines of the later run are deleted.

A deleted line always lies in a run of at least ``run`` lines that occurred before. Of a later
run of ``run + window - 1`` lines or more, all lines are deleted, but for up to ``window - 1`` at
either end where other earlier copies go on differently (none if ``window <= run`` and the first
occurrence has the whole run).

With ``short``, a second pass takes the repeats that are shorter than the guarantee and that no fingerprint
reached: of the lines that are left, each one that is left in an earlier place too goes. The first
occurrence of a line is never deleted by the first pass, so after both (with ``run`` 1) exactly the lines
that occurred before are gone.

Rows of equal doc_id and text are one document and treated alike. Null texts stay null, empty
ones empty. Blank lines stay, but a text whose lines are all deleted becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_at, documents, in_batches, plain_names, small_batches, stash
from .members import member_filter, passes
from .occurrences import NO_ID, doc_key, first_links, pairs

RUN, WINDOW = 2, 2
_SEED = 7


def text_hash(text: bytes) -> int:
    """Signed XXH64, as a long."""
    h = xxhash.xxh64_intdigest(text, _SEED)
    return h - (1 << 64) if h >> 63 else h


def lines_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, line numbers) of the lines that aren't blank."""
    lines = text.split(b"\n")
    at = [i for i, x in enumerate(lines) if x and not x.isspace()]
    return np.array([xxhash.xxh64_intdigest(lines[i], _SEED) for i in at], np.uint64), np.array(at, np.int64)


def grams_of(hashes: np.ndarray, run: int) -> np.ndarray:
    n = len(hashes) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least gram of every window, the rightmost of equals. Fewer grams than a
    window count as one window."""
    if not len(grams):
        return np.zeros(0, np.int64)
    window = min(window, len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, kind))


def _prints(run: int, window: int):
    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, hashes, numbers, marks, places = [], [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                own, at = lines_of(t or b"")
                grams = grams_of(own, run)
                picked = winnow(grams, window)
                hs.append(text_hash(t or b""))
                hashes.append(own.view(np.int64))
                numbers.append(at)
                marks.append(grams[picked].view(np.int64))
                places.append(picked)
            g, p = _lists(marks, pa.int64()), _lists(places, pa.int32())
            m = pa.ListArray.from_arrays(g.offsets, pa.StructArray.from_arrays([g.values, p.values], names=["g", "pos"]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(hs, pa.int64()), _lists(hashes, pa.int64()), _lists(numbers, pa.int32()), m], names=["doc", "h", "lines", "numbers", "marks"])

    return do


def extend(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int]], run: int, same: bool) -> list[tuple[int, int]]:
    """Runs [start, end) of a's lines that match b's around each match; same: a is b, and a run
    must not reach the place it is copied from in itself (its source begins earlier)."""
    out: list[tuple[int, int]] = []
    reach: dict[int, int] = {}
    for i, j in sorted(matches):
        shift = i - j
        if same and shift <= 0 or i < reach.get(shift, 0):
            continue
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        end = i + (int(differ[0]) if len(differ) else n)
        n = min(i, j)
        differ = np.flatnonzero(a[i - n : i][::-1] != b[j - n : j][::-1])
        start = i - (int(differ[0]) if len(differ) else n)
        reach[shift] = end
        if end - start >= run:
            out.append((start, end))
    return out


def _runs(run: int):
    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h, lines = [], [], []
            columns = [b.column(c).to_pylist() for c in ("doc", "h", "doc0", "h0", "at")]
            own, other, numbers = b.column("lines"), b.column("lines0"), b.column("numbers")
            for i, (d, x, d0, x0, at) in enumerate(zip(*columns)):
                a, z = own[i].values.to_numpy(), other[i].values.to_numpy()
                runs = extend(a, z, [(m["pos"], m["pos0"]) for m in at], run, (d, x) == (d0, x0))
                if runs:
                    mine = numbers[i].values.to_numpy()
                    doc.append(d)
                    h.append(x)
                    lines.append(np.unique(np.concatenate([mine[s:e] for s, e in runs])))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), _lists(lines, pa.int32())], names=["doc", "h", "gone"])

    return do


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the lines that are not gone: hash and line number."""
    for b in batches:
        lines, numbers, gone = b.column("lines"), b.column("numbers"), b.column("gone")
        marks, places = [], []
        for i in range(b.num_rows):
            own, at = lines[i].values.to_numpy(), numbers[i].values.to_numpy()
            if gone[i].is_valid:
                keep = ~np.isin(at, gone[i].values.to_numpy())
                own, at = own[keep], at[keep]
            marks.append(own)
            places.append(at)
        g, p = _lists(marks, pa.int64()), _lists(places, pa.int32())
        m = pa.ListArray.from_arrays(g.offsets, pa.StructArray.from_arrays([g.values, p.values], names=["g", "pos"]))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), m], names=["doc", "h", "marks"])


def _numbers(rows: DataFrame) -> DataFrame:
    """doc, h and the sorted, distinct numbers of rows (doc, h, gone: array)."""
    return rows.groupBy("doc", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def short_repeats(arrays: DataFrame, gone: DataFrame, scope: str = "default") -> DataFrame:
    """The second pass: doc, h, gone (array of numbers) of lines that the first pass has left and that
    are left in an earlier place too."""
    left = arrays.join(gone, ["doc", "h"], "left").select("doc", "h", "lines", "numbers", "gone")
    marks = stash(left.transform(in_batches, _left, "doc long, h long, marks array<struct<g:long,pos:int>>"), "left-lines", scope)
    return first_links(marks, scope).groupBy("doc", "h").agg(F.collect_list("pos").alias("gone"))


def repeated_lines(docs: DataFrame, run: int = RUN, window: int = WINDOW, scope: str = "default", short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all, gone): all has doc, h, lines, numbers of every row; gone has doc, h and the sorted
    numbers of deleted lines (from 0) of documents that lose any."""
    source = documents(docs).select(doc_key(F.col("doc_id")).alias("doc"), "text")
    columns = "doc long, h long, lines array<long>, numbers array<int>, marks array<struct<g:long,pos:int>>"
    rows = stash(source.transform(in_batches, _prints(run, window), columns), "lines", scope)
    one = rows.select("doc", "h", "marks").dropDuplicates(["doc", "h"]) if _repeats(rows) else rows
    linked = pairs(first_links(one, scope))
    arrays = rows.select("doc", "h", "lines", "numbers")
    if one is not rows:
        arrays = arrays.dropDuplicates(["doc", "h"])
    both = linked.join(arrays, ["doc", "h"]).join(arrays.select(F.col("doc").alias("doc0"), F.col("h").alias("h0"), F.col("lines").alias("lines0")), ["doc0", "h0"])
    runs = both.select("doc", "h", "doc0", "h0", "at", "lines", "numbers", "lines0").transform(in_batches, _runs(run), "doc long, h long, gone array<int>")
    gone = stash(_numbers(runs), "gone-lines", scope)
    if short:
        gone = stash(_numbers(gone.unionByName(short_repeats(arrays, gone, scope))), "all-gone-lines", scope)
    return rows, gone


def _repeats(rows: DataFrame) -> bool:
    """Whether a document is in the table more than once."""
    return not rows.groupBy("doc", "h").count().where("count > 1").isEmpty()


def line_report(docs: DataFrame, run: int = RUN, window: int = WINDOW, scope: str = "default", short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (numbers from 0), one row per row."""
    rows, gone = repeated_lines(docs, run, window, scope, short)
    deleted = F.coalesce("gone", F.array().cast("array<int>"))
    own = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return rows.select("doc", "h", F.size("numbers").cast("long").alias("n_lines")).join(gone, ["doc", "h"], "left").select(own.alias("doc_id"), "n_lines", F.size(deleted).cast("long").alias("n_deleted"), deleted.alias("deleted"))


def _marked(bits):
    """Adds each row's key and whether it may lose lines."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([text_hash(t or b"") for t in b.column("__text").cast(pa.binary()).to_pylist()], np.int64)
            may = passes(bits.value, h) if len(h) else np.zeros(0, bool)
            arrays = [b.column(c) for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(h), pa.array(may)], names=[*(c for c in b.schema.names if c != "__text"), "__h", "__may"])

    return do


def drop_lines(text: str | None, gone: list[int]) -> str:
    """The text without those lines; empty if only blank ones are left."""
    out = set(gone)
    left = [x for i, x in enumerate((text or "").split("\n")) if i not in out]
    return "\n".join(left) if any(x.strip(" \t\r\x0b\x0c") for x in left) else ""


def _cut(text: str):
    """Deletes the lines ``gone`` from the column named ``text``, and counts them."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column("gone").to_pylist()
            cut = pa.array([drop_lines(t, g) if g else t for t, g in zip(b.column(text).to_pylist(), gone)], pa.string())
            names = [c for c in b.schema.names if c != "gone"]
            arrays = [cut if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(g or ()) for g in gone], pa.int64())], names=[*names, "n_deleted"])

    return do


def line_dedup(docs: DataFrame, run: int = RUN, window: int = WINDOW, scope: str = "default", short: bool = False) -> DataFrame:
    """The table with repeated lines deleted from ``text``; all columns kept, and n_deleted
    (long) added as the last. Only rows that may lose lines are shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    _, gone = repeated_lines(docs, run, window, scope, short)
    bits = spark.sparkContext.broadcast(member_filter(gone.select("h")))
    plain, names = plain_names(docs)
    text, doc_id = column_at(docs, "text"), column_at(docs, "doc_id")
    own = [T.StructField(f.name, f.dataType) for f in plain.schema]
    keyed = plain.withColumn("__text", F.col(text).cast("string")).transform(in_batches, _marked(bits), T.StructType([*own, T.StructField("__h", T.LongType()), T.StructField("__may", T.BooleanType())]))
    may = keyed.where("__may").withColumn("__doc", doc_key(F.col(doc_id).cast("long")))
    # A shuffled join: so no task needs two Python workers at once, and no side must be small.
    hit = may.join(gone.hint("merge"), (F.col("__doc") == F.col("doc")) & (F.col("__h") == F.col("h")), "left").select(*names, "gone")
    changed = hit.transform(in_batches, _cut(text), T.StructType([*own, T.StructField("n_deleted", T.LongType())]))
    same = keyed.where("not __may").select(*names, F.lit(0).cast("long").alias("n_deleted"))
    return same.unionByName(changed).toDF(*docs.columns, "n_deleted")
