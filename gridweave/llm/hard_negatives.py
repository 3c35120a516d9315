"""Hard negatives by norm-bucketed search over integer vectors.

Every row is a candidate: rows are sorted by label and falling norm, and packed into buckets of at
most ``BUCKET`` rows of one label, each with its largest norm. Anchors, a stated part of the rows,
are packed into blocks of at most ``BLOCK``. Buckets are dealt to blocks, several streams to a
block, and each stream meets its buckets from the largest norm down, one at a time: a bucket is
passed over for an anchor when the product of both norms (Cauchy-Schwarz) is under what the anchor
still asks for, and a stream ends when that holds for all its anchors. Two such searches follow one
another:

* positives: the ``positives`` highest scores of the anchor's own label; asked for is the running
  kth score;
* negatives: for each positive the ``negatives`` highest scores of other labels in its window
  ``low * positive_score <= 100 * score <= high * positive_score``; asked for is the larger of the
  window's lower limit and the window's running kth score, the least over the anchor's windows.
  Buckets that are under the lower limit of all anchors of a block are not even sent to it.

The best of each stream are merged at the end. A task holds one block and one bucket, whatever the
size of the table, of a label or of a group of equal vectors. Scores are exact integers.

A row without vec_id, label or vector, or with a component that is null or not finite, takes no
part. Rows that repeat wholly count once. Rows that share a vec_id and differ are different rows:
each may be an anchor, and of equal scores and ids the one with the smaller hash comes first. A
shorter vector is filled up with zeros. Components so large that a score might not fit a long raise
an error. A label with one row gives no positive; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, least_partitions, pick, small_batches, stash

BUCKET, BLOCK = 1024, 4096
#: Full buckets that a stream has at least, on average.
STREAM_BUCKETS = 8
#: Bytes of block bounds that may be broadcast: 40 a block, so 1.6 million blocks of 4,096 anchors.
MAX_BOUNDS = 64 << 20
_FITS = float(1 << 62)
_PACKED = "label long, top double, n int, dim int, width int, ids binary, ties binary, labels binary, vecs binary, norms binary, lows binary, highs binary"
_STREAM = f"block long, salt int, kind int, {_PACKED}"
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label (long), q: floor(scale * component) of the rows that take part, norm, tie."""
    small_batches(vectors.sparkSession)
    plain = pick(vectors, "vec_id", "label", "embedding", vec_id="long", label="long", embedding="array<double>")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    scaled = rows.withColumn("_d", F.transform("embedding", lambda v: v * scale))
    square = F.aggregate("_d", F.lit(0.0), lambda s, v: s + (F.abs(v) + 1) * (F.abs(v) + 1))
    whole = F.when(square < _FITS, F.transform("_d", lambda v: F.floor(v).cast("long"))).otherwise(F.raise_error(F.lit("a score of these vectors might not fit a long")))
    out = scaled.select("vec_id", "label", whole.alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return out.withColumns({"norm": norm, "tie": F.xxhash64("label", "q")})


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of integers, filled up with zeros to the longest."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    at = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], size)
    out[np.repeat(np.arange(len(size)), size), at] = lists.values.to_numpy()[ends[0] : ends[-1]]
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    most = int(np.abs(m).max(initial=0))
    return m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _packed(t: pa.Table, windows: bool) -> dict:
    """One row of _PACKED for these rows."""
    m = _narrow(_matrix(t.column("q").combine_chunks()))
    col = lambda c: t.column(c).to_numpy()
    norms = col("norm").astype(np.float64)
    out = {"label": int(col("label")[0]), "top": float(norms.max()), "n": len(norms), "dim": m.shape[1], "width": m.itemsize, "ids": col("vec_id").tobytes(), "ties": col("tie").tobytes()}
    out |= {"labels": col("label").tobytes(), "vecs": m.tobytes(), "norms": norms.tobytes()}
    side = lambda c: _matrix(t.column(c).combine_chunks()).tobytes() if windows else b""
    return out | {"lows": side("lows"), "highs": side("highs")}


def _runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of at most ``most`` rows that agree in ``key``, from a sorted stream."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        while True:
            k = rest.column(key).to_numpy()
            other = np.flatnonzero(k != k[0])
            n = min(int(other[0]) if len(other) else len(k), most)
            if n == len(k) < most:
                break
            yield rest.slice(0, n)
            rest = rest.slice(n)
            if not rest.num_rows:
                rest = None
                break
    if rest is not None:
        yield rest


def _pack(key: str, most: int, windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, key, most):
            own = {**_packed(t, windows), "block": int(t.column("block")[0].as_py()) if windows else 0}
            yield pa.RecordBatch.from_pylist([own], pa.schema([*_PACKED_ARROW, ("block", pa.int64())]))

    return run


_PACKED_ARROW = [(name, {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in _PACKED.split(", "))]
_STREAM_ARROW = pa.schema([("block", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), *_PACKED_ARROW])


def _buckets(rows: DataFrame) -> DataFrame:
    """Rows by label and falling norm, packed; written, so that they are packed once."""
    ordered = rows.repartitionByRange("label", F.desc("norm"), "vec_id", "tie").sortWithinPartitions("label", F.desc("norm"), "vec_id", "tie")
    return stash(ordered.transform(in_batches, _pack("label", BUCKET, False), f"{_PACKED}, block long").drop("block"), "norm-buckets")


def _blocks(anchors: DataFrame) -> DataFrame:
    """Anchors (with lows and highs), by label and norm, packed into full blocks whatever the partitions are."""
    ordered = anchors.repartitionByRange("label", F.desc("norm"), "vec_id", "tie").sortWithinPartitions("label", F.desc("norm"), "vec_id", "tie")
    place = F.monotonically_increasing_id()
    ranked = stash(ordered.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("turn")), "anchors")
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    numbered = ranked.join(F.broadcast(before), "part").withColumn("block", F.expr(f"(before + turn) div {BLOCK}"))
    packed = numbered.repartition("block").sortWithinPartitions("block", "part", "turn").drop("part", "turn", "before")
    return stash(packed.transform(in_batches, _pack("block", BLOCK, True), f"{_PACKED}, block long"), "anchor-blocks")


def _bounds(blocks: DataFrame):
    """Of each block its number, least and largest label, largest norm and the least lower limit; one
    entry for 4,096 anchors, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                labels, lows = np.frombuffer(row["labels"], np.int64), np.frombuffer(row["lows"], np.int64)
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "first": int(labels.min()), "last": int(labels.max()), "top": row["top"], "low": int(lows.min())}])

    found = blocks.transform(in_batches, run, "block long, first long, last long, top double, low long")
    if found.count() * 40 > MAX_BOUNDS:
        raise ValueError("too many anchors for one search: split them")
    t = found.orderBy("block").toArrow()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _route(held, salts: int, same: bool):
    """Sends each bucket to the blocks that may need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        for b in batches:
            for i in range(b.num_rows):
                label, top, ids = b.column("label")[i].as_py(), b.column("top")[i].as_py(), b.column("ids")[i].as_py()
                if same:
                    own = (x["first"] <= label) & (label <= x["last"])
                else:
                    own = ((x["first"] != label) | (x["last"] != label)) & (_bound(x["top"], top) >= x["low"].astype(np.float64))
                at = x["block"][own]
                salt = int(np.frombuffer(ids[:8], np.int64)[0]) % salts
                for some in np.array_split(at, -(-len(at) // 32)) if len(at) else ():
                    take = b.slice(i, 1).take(pa.array(np.zeros(len(some), np.int64)))
                    lead = [pa.array(some), pa.array(np.full(len(some), salt), pa.int32()), pa.array(np.ones(len(some)), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*lead, *(take.column(n) for n, _ in _PACKED_ARROW)], schema=_STREAM_ARROW)

    return run


def _bound(a, b):
    """No score is above this: the product of the norms, and what rounding may take off it."""
    return a * b * (1 + 1e-9) + 1e-6


def _vectors(row: dict, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["width"]]
    m = np.frombuffer(row["vecs"], kind).reshape(row["n"], row["dim"])
    return np.pad(m, ((0, 0), (0, dim - row["dim"])))


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Exact inner products; in doubles where all of them fit 53 bits."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class _Search:
    """Best candidates of each (anchor, window) of a block, while its buckets stream by."""

    def __init__(self, row: dict, keep: int, same: bool):
        self.row, self.keep, self.same = row, keep, same
        read = lambda c: np.frombuffer(row[c], np.int64)
        self.ids, self.ties, self.labels = read("ids"), read("ties"), read("labels")
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.lows, self.highs = (read(c).reshape(len(self.ids), -1) for c in ("lows", "highs"))
        self.kth = self.lows.copy()
        self.found: np.ndarray = np.zeros((5, 0), np.int64)  # anchor, window, score, id, tie
        #: Windows that fill up the array of an anchor with fewer positives ask for nothing.
        self.open = self.lows <= self.highs

    def asked(self) -> np.ndarray:
        """The least score that still counts, of each anchor."""
        return np.where(self.open, self.kth, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)

    def meet(self, bucket: dict) -> None:
        asked = self.asked()
        other = (self.labels == bucket["label"]) == self.same
        rows = np.flatnonzero(other & (_bound(self.norms, bucket["top"]) >= asked.astype(np.float64)))
        if not len(rows):
            return
        dim = max(self.row["dim"], bucket["dim"])
        own, candidates = _vectors(self.row, dim), _vectors(bucket, dim)
        ids, ties = np.frombuffer(bucket["ids"], np.int64), np.frombuffer(bucket["ties"], np.int64)
        exact = self.row["top"] * bucket["top"] < 2.0**52
        for part in np.array_split(rows, -(-len(rows) // 512)):
            s = _scores(own[part], candidates, exact)
            most = np.where(self.open[part], self.highs[part], _NONE).max(axis=1)
            i, j = np.nonzero((s >= asked[part][:, None]) & (s <= most[:, None]))
            if self.same:
                mine = (self.ids[part[i]] == ids[j]) & (self.ties[part[i]] == ties[j])
                i, j = i[~mine], j[~mine]
            self.add(part[i], s[i, j], ids[j], ties[j])

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> None:
        new = [self.found]
        for w in range(self.lows.shape[1]):
            fit = (score >= self.kth[anchor, w]) & (score <= self.highs[anchor, w])
            if fit.any():
                new.append(np.stack([anchor[fit], np.full(int(fit.sum()), w), score[fit], ids[fit], ties[fit]]))
        if len(new) == 1:
            return
        x = np.concatenate(new, axis=1)
        x = x[:, np.lexsort((x[4], x[3], -x[2], x[1], x[0]))]
        again = (x[:, 1:] == x[:, :-1]).all(axis=0)
        x = x[:, np.concatenate([[True], ~again])]
        first = np.concatenate([[True], (x[:2, 1:] != x[:2, :-1]).any(axis=0)])
        place = np.arange(x.shape[1])
        rank = place - np.maximum.accumulate(np.where(first, place, 0))
        self.found = x = x[:, rank < self.keep]
        full = rank[rank < self.keep] == self.keep - 1
        self.kth[x[0, full], x[1, full]] = x[2, full]

    def result(self) -> pa.RecordBatch:
        a, w, s, i, t = self.found
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[a], self.ties[a], w, s, i, t)], names=["anchor", "anchor_tie", "w", "score", "id", "tie"])


def _search(keep: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, over = None, None, False
        for b in batches:
            for i in range(b.num_rows):
                here = (b.column("block")[i].as_py(), b.column("salt")[i].as_py())
                if here == at and b.column("kind")[i].as_py() and over:
                    continue  # the rest of the stream has smaller norms still
                row = b.slice(i, 1).to_pylist()[0]
                if not row["kind"]:
                    if now is not None:
                        yield now.result()
                    now, at, over = _Search(row, keep, same), here, False
                else:
                    over = not (_bound(now.norms, row["top"]) >= now.asked().astype(np.float64)).any()
                    if not over:
                        now.meet(row)
        if now is not None:
            yield now.result()

    return run


def _best(buckets: DataFrame, blocks: DataFrame, keep: int, same: bool) -> DataFrame:
    """anchor, anchor_tie, w, score, id, tie, rank: the first ``keep`` of each window."""
    spark = buckets.sparkSession
    bounds = _bounds(blocks)
    # Streams enough for all tasks, each with buckets enough that its kth score may rule out others.
    rows = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    salts = max(1, min(-(-2 * least_partitions(spark) // max(1, len(bounds["block"]))), -(-rows // (STREAM_BUCKETS * BUCKET))))
    held = spark.sparkContext.broadcast(bounds)
    sent = buckets.transform(in_batches, _route(held, salts, same), _STREAM)
    own = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *(n for n, _ in _PACKED_ARROW))
    met = own.unionByName(sent).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", F.desc("top"))
    found = met.transform(in_batches, _search(keep, same), "anchor long, anchor_tie long, w long, score long, id long, tie long").distinct()
    order = Window.partitionBy("anchor", "anchor_tie", "w").orderBy(F.desc("score"), "id", "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of quantised rows.

    ``is_anchor`` is a condition over vec_id and label.
    """
    buckets = _buckets(rows)
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False))).dropDuplicates(["vec_id", "tie"])
    every = lambda v: F.array(F.lit(v).cast("long"))
    seeking = _blocks(anchors.withColumns({"lows": every(_NONE + 1), "highs": every((1 << 63) - 1)}))
    best = _best(buckets, seeking, positives, True)
    pairs = stash(best.select("anchor", "anchor_tie", (F.col("rank") - 1).cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scaled = lambda part: F.col("positive_score").cast("decimal(20,0)") * part
    least, most = F.ceil(scaled(low) / 100).cast("long"), F.floor(scaled(high) / 100).cast("long")
    lists = pairs.groupBy("anchor", "anchor_tie").agg(F.array_sort(F.collect_list(F.struct("w", least.alias("lo"), most.alias("hi")))).alias("s"))
    # An anchor with fewer positives has windows that hold nothing, so that all have as many.
    fill = lambda name, empty: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at(f"s.{name}", i), F.lit(empty).cast("long")))
    windows = lists.select(F.col("anchor").alias("vec_id"), F.col("anchor_tie").alias("tie"), fill("lo", (1 << 63) - 1).alias("lows"), fill("hi", _NONE + 1).alias("highs"))
    armed = _blocks(anchors.join(windows, ["vec_id", "tie"]))
    found = _best(buckets, armed, negatives, False)
    out = found.join(pairs, ["anchor", "anchor_tie", "w"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
