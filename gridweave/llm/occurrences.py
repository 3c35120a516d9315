"""Joins of positions that share a fingerprint, without pairs inside a group.

Every occurrence of a repeated fingerprint is linked to the first one (``first_links``), or to the first one and the one right
before it (``near_links``), by document, text hash and position. So links grow with the occurrences, however frequent a fingerprint is.
A document is known by ``doc`` (its doc_id, nulls last as the largest long) and ``h`` (a hash of
its text): rows that repeat both are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLAIN, fixed_size, in_batches, least_partitions, stash, whole_groups
from .members import member_filter, passes

NO_ID = (1 << 63) - 1


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(NO_ID))


def _may_repeat(bits):
    """Leaves the marks out that pass no filter, and rows without any."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column("marks")
            g, pos = marks.flatten().field("g"), marks.flatten().field("pos")
            sizes = pc.list_value_length(marks).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(passes(bits.value, g.to_numpy())) if len(g) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)[some]
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([g.take(at), b.column("doc").take(pa.array(row)), b.column("h").take(pa.array(row)), pos.take(at)], names=["g", "doc", "h", "pos"])

    return do


def first_links(rows: DataFrame, scope: str = "default") -> DataFrame:
    """rows: doc, h, marks (array of struct g long, pos int). Returns doc, h, pos and of the
    first occurrence doc0, h0, pos0, for every occurrence but the first.

    Fingerprints are counted first; a filter, whose size follows their number, then keeps nearly all others out of
    the shuffle that brings the occurrences of one fingerprint together.
    """
    repeated = stash(rows.select(F.explode("marks.g").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "repeated-marks", scope)
    bits = rows.sparkSession.sparkContext.broadcast(member_filter(repeated))
    found = rows.select("doc", "h", "marks").transform(in_batches, _may_repeat(bits), "g long, doc long, h long, pos int")
    # Aggregated within tasks first; written, so that the join below can be split where a fingerprint is frequent.
    first = stash(_first(found), "first-marks", scope)
    return found.join(first, "g").where(_OTHER).select("doc", "h", "pos", "doc0", "h0", "pos0")


_OTHER = "doc != doc0 or h != h0 or pos != pos0"


def _first(found: DataFrame) -> DataFrame:
    """g, doc0, h0, pos0: where each fingerprint of several occurrences is first."""
    first = found.groupBy("g").agg(F.min(F.struct("doc", "h", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return first.select("g", F.col("f.doc").alias("doc0"), F.col("f.h").alias("h0"), F.col("f.pos").alias("pos0"))


#: An occurrence, in bytes whose order is that of (doc, h, pos), and a link. Spark hands a row of one long and one binary value
#: to Python at a third of what as many numbers cost.
_SIGN = np.uint64(1 << 63)
_OCCURRENCE = np.dtype([("doc", ">u8"), ("h", ">u8"), ("pos", ">u4"), ("span", "<i8")])
_PAIR = ("doc", "h", "doc0", "h0")
_LINKED = np.dtype([(c, "<i8") for c in (*_PAIR, "at")])


def _fixed(records: np.ndarray) -> pa.Array:
    """Records as binary values."""
    ends = np.arange(len(records) + 1, dtype=np.int32) * np.int32(records.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(records), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(records))])


def _records(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(c.buffers()[2], kind, len(c), np.frombuffer(c.buffers()[1], np.int32)[c.offset]) for c in column.chunks if len(c)])


def mark_array(g: np.ndarray, doc: np.ndarray, h: np.ndarray, pos: np.ndarray, span: np.ndarray) -> pa.StructArray:
    """Marks for near_links."""
    out = np.empty(len(g), _OCCURRENCE)
    out["doc"], out["h"], out["pos"], out["span"] = doc.view(np.uint64) ^ _SIGN, h.view(np.uint64) ^ _SIGN, pos, span
    return pa.StructArray.from_arrays([pa.array(g), _fixed(out)], names=["g", "rec"])


MARKS = "array<struct<g:long,rec:binary>>"


def _links(doc, h, pos, doc0, h0, pos0, whole: bool) -> list[pa.Array]:
    """Keys that are equal for a pair of documents, and links."""
    out = np.empty(len(doc), _LINKED)
    for c, x in zip(_PAIR, (doc, h, doc0, h0)):
        out[c] = x
    out["at"] = pos.astype(np.int64) << 32 | pos0.astype(np.int64) << 1 | int(whole)
    key = np.zeros(len(doc), np.uint64)
    for c in _PAIR:
        key = (key ^ out[c].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return [pa.array(key.view(np.int64)), _fixed(out)]


def _packed(whole: bool):
    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(_links(*(b.column(c).to_numpy() for c in ("doc", "h", "pos", "doc0", "h0", "pos0")), whole), names=["pair", "rec"])

    return do


def _to_first(first, whole: bool):
    """Links of occurrences with the first ones, a table by fingerprint."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g0, doc0, h0, pos0 = (first.value.column(c).to_numpy() for c in ("g", "doc0", "h0", "pos0"))
        for b in batches:
            g, doc, h, pos = (b.column(c).to_numpy() for c in ("g", "doc", "h", "pos"))
            at = np.searchsorted(g0, g)
            some = np.flatnonzero(np.append(g0, 0)[at] == g) if len(g0) else np.zeros(0, np.int64)
            some = some[at[some] < len(g0)]
            at = at[some]
            other = (doc[some] != doc0[at]) | (h[some] != h0[at]) | (pos[some] != pos0[at])
            some, at = some[other], at[other]
            yield pa.RecordBatch.from_arrays(_links(doc[some], h[some], pos[some], doc0[at], h0[at], pos0[at], whole), names=["pair", "rec"])

    return do


def links_of(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted links: doc, h, doc0 and h0; pos; pos0; and which of them are of whole passages."""
    rec = _records(table.column("rec"), _LINKED)
    columns = {c: np.ascontiguousarray(rec[c]) for c in (*_PAIR, "at")}
    order = np.lexsort([columns[c] for c in ("at", *reversed(_PAIR))])
    columns = {c: x[order] for c, x in columns.items()}
    at = columns.pop("at")
    return columns, at >> 32, (at & 0xFFFFFFFF) >> 1, (at & 1).astype(bool)


#: Kinds of rows that _near makes: links; occurrences whose fingerprint may go on in other tasks; a task's first and last
#: occurrence (span is 1 for the first); places of frequent spans.
_LINK, _OPEN, _EDGE, _PLACE = range(4)
_NEAR = pa.schema([("kind", pa.int32()), ("pair", pa.int64()), ("rec", pa.binary()), ("g", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("span", pa.int64())])


def _near(previous: bool):
    """Occurrences sorted by fingerprint; see near_links."""

    def found(table: pa.Table, head: bool, tail: bool) -> Iterator[pa.RecordBatch]:
        g, rec = table.column("g").to_numpy(), _records(table.column("rec"), _OCCURRENCE)
        doc, h = ((rec[c].astype(np.uint64) ^ _SIGN).view(np.int64) for c in ("doc", "h"))
        pos, span = rec["pos"].astype(np.int32), rec["span"].astype(np.int64)
        order = np.lexsort((pos, h, doc, g))
        g, doc, h, pos, span = (x[order] for x in (g, doc, h, pos, span))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
        sizes = np.diff(bounds)
        first, own = np.repeat(bounds[:-1], sizes), np.arange(len(g))
        open_ = head & (first == 0) | tail & (first == bounds[-2])
        links = [(own[x], y[x]) for x, y in ((~open_ & (own > first), first), ((own > first) & (open_ | (own - 1 > first)) & previous, own - 1))]
        # Equal spans have equal fingerprints, so those of a closed group are all here.
        some = np.flatnonzero(~open_ & (span != 0) & (np.repeat(sizes, sizes) > 1))
        some = some[np.argsort(span[some], kind="stable")]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(span[some])) + 1, [len(some)]]) if len(some) else np.zeros(1, np.int64)
        n = np.diff(starts)
        two = starts[:-1][n == 2]
        links.append((some[two + 1], some[two]))
        x, y = (np.concatenate(z) for z in zip(*links))
        if len(x):
            pair, rec = _links(doc[x], h[x], pos[x], doc[y], h[y], pos[y], not previous)
            yield rows(_LINK, pair=pair, rec=rec)
        for kind, some in ((_PLACE, some[np.repeat(n > 2, n)]), (_OPEN, np.flatnonzero(open_)), (_EDGE, np.array([0] * head + [len(g) - 1] * tail, np.int64))):
            if len(some):
                last = pa.array(np.array([1] * head + [0] * tail, np.int64) if kind == _EDGE else span[some])
                yield rows(kind, g=pa.array(g[some]), doc=pa.array(doc[some]), h=pa.array(h[some]), pos=pa.array(pos[some]), span=last)

    def rows(kind: int, **columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["kind"] = pa.array(np.full(n, kind, np.int32))
        return pa.RecordBatch.from_arrays([columns[c.name] if c.name in columns else pa.nulls(n, c.type) for c in _NEAR], schema=_NEAR)

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = True, None
        for table in whole_groups(batches, ("g",), 1 << 17):
            if held is not None:
                yield from found(held, head, False)
                head = False
            held = table
        if held is not None:
            yield from found(held, head, True)

    return do


def near_links(rows: DataFrame, scope: str = "default", previous: bool = True) -> tuple[DataFrame, DataFrame]:
    """rows.marks: of every occurrence (see mark_array) the fingerprint g, document, position, and with ``previous`` a hash
    of more words from there (span), or zero. Links (pair, rec; see links_of) of every occurrence with the first one, and with ``previous``
    also with the one right before it and with the only other one of the same span. And the places (doc, h, pos) of spans that occur more than twice.

    One shuffle: occurrences are dealt by ranges of (fingerprint, document, position), so a frequent fingerprint is spread over tasks.
    What is known within a task is found there; the fingerprints of a task's ends, two a task, are joined across tasks.
    """
    # One long is sorted by radix; the rest of the order follows a group at a time.
    dealt = rows.select(F.inline("marks")).repartitionByRange(least_partitions(rows.sparkSession), "g", "rec").sortWithinPartitions("g")
    with fixed_size(rows.sparkSession):
        held = stash(dealt.transform(in_batches, _near(previous), "kind int, pair long, rec binary, g long, doc long, h long, pos int, span long"), "near-marks", scope, **PLAIN)
    names = ("doc", "h", "pos", "doc0", "h0", "pos0")
    place = F.struct("doc", "h", "pos")
    open_ = held.where(F.col("kind") == _OPEN).select("g", "doc", "h", "pos", "span")
    links = held.where(F.col("kind") == _LINK).select("pair", "rec")
    # At most two rows a task.
    first = rows.sparkSession.sparkContext.broadcast(_first(open_).orderBy("g").toArrow())
    links = links.unionByName(open_.select(*names[:3], "g").transform(in_batches, _to_first(first, not previous), "pair long, rec binary"))
    places = held.where(F.col("kind") == _PLACE).select(*names[:3])
    if previous:
        # Two rows a task: the last of one is right before the first of the next.
        window = Window.partitionBy("g").orderBy("doc", "h", "pos")
        edges = held.where(F.col("kind") == _EDGE).groupBy("g", "doc", "h", "pos").agg(F.max("span").alias("head"))
        across = edges.select("head", "doc", "h", "pos", *(F.lag(c).over(window).alias(f"{c}0") for c in names[:3])).where("doc0 is not null and head = 1")
        each = stash(open_.where("span != 0").groupBy("span").agg(F.count("*").alias("n"), F.min(place).alias("f"), F.max(place).alias("l")).where("n > 1"), "spans", scope)
        twice = each.where("n = 2").select(*(F.col(f"l.{c}").alias(c) for c in names[:3]), *(F.col(f"f.{c}").alias(f"{c}0") for c in names[:3]))
        often = open_.join(each.where("n > 2").select("span"), "span", "left_semi")
        more = across.select(*names).unionByName(twice).transform(in_batches, _packed(not previous), "pair long, rec binary")
        links, places = links.unionByName(more), places.unionByName(often.select(*names[:3]))
    return links, places


def pairs(links: DataFrame) -> DataFrame:
    """One row per pair of documents: doc, h, doc0, h0, at (array of struct pos, pos0). A pair's
    links are no more than the fingerprints of its document."""
    return links.groupBy("doc", "h", "doc0", "h0").agg(F.collect_list(F.struct("pos", "pos0")).alias("at"))
