"""Mixing sources to target weights, by blocks of words joined by index.

The words of a source, its documents in order of doc_id, are one stream, cut into blocks of
``block`` words (the last may be shorter). A source's target is its share, by weight, of a budget
of words; targets stop at ``most`` times the source's size and the rest is shared again by weight.

The mix is a list of slots, a block each, in shards of ``SHARD`` slots. A source has as many slots as its
target needs, the last one cut, so that the words taken differ from the target by less than one.
The counts of sources in a shard are a multinomial draw given those whole totals (a multivariate
hypergeometric one): a binary tree over the shards halves the totals with a generator seeded by the
node, so that every task finds its shards' counts, and how many slots of each source lie before,
without the others. Slot k of a source is mapped to a block by the pseudorandom permutation of pass
``k // blocks`` over the source (a Feistel network that walks its cycle), so each pass takes each
block once. Slots and blocks are then joined by source and block.

All of it follows from the data and ``seed``: reruns, recomputed tasks and other partitionings give
the same mix. No task holds a source: places in a stream are sums within range-partitioned
tasks plus what lies before the task. The driver holds a row a source and a row a task.

A null text, or one without words, has size zero and is taken zero times. Null is a source of its
own, the last one. Rows that repeat are documents of their own; of equal doc_ids the shorter text
comes first, null ids last. Sources whose words are all zero have the target zero; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, pick, small_batches, stash

BLOCK, SHARD = 1024, 4096
#: Sources whose totals the driver and each task hold; more are refused.
MAX_SOURCES = 100_000
#: numpy draws up to this many; larger totals are first halved evenly.
_DRAWN = 500_000_000
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight, none above ``most`` times its size; what is above is shared
    again by weight among the others until none is."""
    out = [0.0] * len(sizes)
    left, rest = set(range(len(sizes))), float(budget)
    while left:
        whole = sum(weights[i] for i in left)
        over = [i for i in left if rest * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in left:
                out[i] = rest * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left.discard(i)
        rest -= sum(out[i] for i in over)
    return out


def _scrambled(x: np.ndarray, key: int, round_: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + round_ * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(3, -1, -1) if back else range(4):
        if back:
            left, right = right ^ (_scrambled(left, key, r) & mask), left
        else:
            left, right = right, left ^ (_scrambled(right, key, r) & mask)
    return (left << np.uint64(half)) | right


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) at these indices (its inverse with ``back``)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    x = _feistel(index.astype(np.uint64), half, key, back)
    while (out := x >= np.uint64(n)).any():
        x[out] = _feistel(x[out], half, key, back)
    return x.astype(np.int64)


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * 1_000_003 + turn


def slots_of(size: int, want: int, block: int, seed: int, source: int) -> tuple[int, int]:
    """(slots, words of the last one) that take ``want`` words of a source of this size."""
    if not size or not want:
        return 0, 0
    n = -(-size // block)
    turns, rest = divmod(want, size)
    last = size - (n - 1) * block
    if not rest:
        final = int(permuted(np.array([n - 1]), n, _key(seed, source, turns - 1))[0])
        return turns * n, last if final == n - 1 else block
    short = int(permuted(np.array([n - 1]), n, _key(seed, source, turns), back=True)[0])  # when the short block comes
    before = short * block
    if rest <= before:
        q = -(-rest // block)
        return turns * n + q, rest - (q - 1) * block
    if rest <= before + last:
        return turns * n + short + 1, rest - before
    q = -(-(rest - before - last) // block)
    return turns * n + short + 1 + q, rest - before - last - (q - 1) * block


def _halved(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of the slots of each source are among the first ``n``, drawn without replacement."""
    whole = int(counts.sum())
    if whole <= _DRAWN:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    even = [int(c) * n // whole for c in counts.tolist()]
    for i in rng.permutation(np.flatnonzero(counts))[: n - sum(even)].tolist():
        even[i] += 1
    return np.array(even, np.int64)


def shard_counts(counts: np.ndarray, first: int, end: int, size: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, slots of each source in it) for shards [first, end)."""
    whole = int(counts.sum())

    def walk(lo: int, hi: int, before: np.ndarray, own: np.ndarray):
        if hi <= first or lo >= end:
            return
        if hi - lo == 1:
            yield lo, before, own
            return
        mid = (lo + hi) // 2
        left = _halved(own, (mid - lo) * size, np.random.default_rng([seed, lo, hi]))
        yield from walk(lo, mid, before, left)
        yield from walk(mid, hi, before + left, own - left)

    yield from walk(0, -(-whole // size), np.zeros_like(counts), counts.astype(np.int64))


def _slots(held):
    """shard, slot, source, block, words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        for b in batches:
            for shard in b.column("id").to_pylist():
                for _, before, own in shard_counts(x["slots"], shard, shard + 1, SHARD, x["seed"]):
                    rng = np.random.default_rng([x["seed"], shard])
                    source = np.repeat(np.arange(len(own)), own)
                    k = np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(before, own)
                    block = np.zeros(len(source), np.int64)
                    for s in np.flatnonzero(own).tolist():
                        mine = source == s
                        turn = k[mine] // x["blocks"][s]
                        at = k[mine] % x["blocks"][s]
                        for t in np.unique(turn).tolist():
                            at[turn == t] = permuted(at[turn == t], int(x["blocks"][s]), _key(x["seed"], s, t))
                        block[mine] = at
                    words = np.where(k == x["slots"][source] - 1, x["last"][source], x["block"])
                    order = rng.permutation(len(source))
                    columns = [np.full(len(source), shard), np.arange(len(source)) + shard * SHARD, source[order], block[order], words[order]]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["shard", "slot", "source", "block", "words"])

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows sorted by source what lies before them of their source in this task."""
    last, total = None, 0
    for b in batches:
        source, size = b.column("source").to_numpy(), b.column("size").to_numpy()
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.zeros(0, np.int64)
        reach = np.repeat(before[first], np.diff(np.append(first, len(source))))
        start = before - reach
        if len(source) and source[0] == last:
            start[source == last] += total
        if len(source):
            total = int(start[-1] + size[-1])
            last = source[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.int64())], names=[*b.schema.names, "start"])


class Mix:
    """The plan of a mix over documents (doc_id, text, source).

    ``weights`` repeat over the sources in order of their code points, null last; together they
    share ``share`` of all words, no source above ``most`` times its own.
    """

    def __init__(self, docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 11, scope: str = "default"):
        if min(weights) <= 0 or share > most:
            raise ValueError("weights must be positive, and the share no more than sources may be repeated")
        self.spark, self.block, self.seed, self.scope, self.docs = docs.sparkSession, block, seed, scope, docs
        self._documents: DataFrame | None = None
        small_batches(self.spark)
        plain = pick(docs, "doc_id", "text", "source", doc_id="long", text="string", source="string")
        self.sized = stash(plain.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size")), "sizes", scope)
        rows = self.sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        order = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode()))
        self.names = [r.source for r in order]
        self.sizes = [r.n for r in order]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(order))], share * sum(self.sizes), most)
        plan = [slots_of(n, round(t), block, seed, i) for i, (n, t) in enumerate(zip(self.sizes, self.targets))]
        self.slot_counts, self.last = np.array([p[0] for p in plan], np.int64), np.array([p[1] for p in plan], np.int64)

    def _sources(self) -> DataFrame:
        """source_name, source (its number), source_size, target."""
        rows = list(zip(self.names, range(len(self.names)), self.sizes, self.targets))
        return self.spark.createDataFrame(rows, "source_name string, source int, source_size long, target double")

    def _numbered(self, df: DataFrame) -> DataFrame:
        own = F.broadcast(self._sources())  # MAX_SOURCES rows at most
        return df.withColumnRenamed("source", "name").join(own, F.col("name").eqNullSafe(F.col("source_name"))).drop("name", "source_name")

    def _placed(self, rows: DataFrame, kind: str, name: str) -> DataFrame:
        """Adds row (a number of its own) and start, the words of the source that lie before, to rows
        with source, no_id, doc_id, size and tie. The order is by ranges, so a large source is spread
        over tasks; what lies before a task follows from sums by task and source."""
        order = ("source", "no_id", "doc_id", "size", "tie")
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).transform(in_batches, _starts, f"source int, no_id boolean, doc_id long, size long, tie long, {kind}start long")
        held = stash(placed.drop("no_id", "tie").withColumn("row", F.monotonically_increasing_id()), name, self.scope)
        part = F.shiftright("row", 33)
        sums = held.groupBy("source", part.alias("part")).agg(F.sum("size").alias("n")).collect()  # rows: tasks and sources
        before, total = [], {}
        for r in sorted(sums, key=lambda r: (r.source, r.part)):
            before.append((r.source, r.part, total.get(r.source, 0)))
            total[r.source] = total.get(r.source, 0) + r.n
        offsets = F.broadcast(self.spark.createDataFrame(before, "source int, part long, before long"))
        return held.withColumn("part", part).join(offsets, ["source", "part"]).withColumn("start", F.col("start") + F.col("before")).drop("part", "before")

    def documents(self) -> DataFrame:
        """row, doc_id, source, size, start: a row a document; placed once."""
        if self._documents is not None:
            return self._documents
        rows = self._numbered(self.sized).select("source", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", F.lit(0).cast("long").alias("tie"))
        self._documents = self._placed(rows, "", "places")
        return self._documents

    def slots(self) -> DataFrame:
        """shard, slot, source, block, words: the mix, a row a slot; takes the block's first ``words``."""
        held = self.spark.sparkContext.broadcast({"slots": self.slot_counts, "last": self.last, "block": self.block, "seed": self.seed, "blocks": np.array([-(-n // self.block) for n in self.sizes], np.int64)})
        shards = -(-int(self.slot_counts.sum()) // SHARD)
        return self.spark.range(shards).transform(in_batches, _slots(held), "shard long, slot long, source long, block long, words long").withColumn("source", F.col("source").cast("int"))

    def pieces(self) -> DataFrame:
        """row, doc_id, source, block, at (in the block), skip (words of the document before it), words."""
        first, last = F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}")
        cut = self.documents().where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
        begin, end = F.greatest("start", F.col("block") * self.block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        return cut.select("row", "doc_id", "source", "block", (begin - F.col("block") * self.block).alias("at"), (begin - F.col("start")).alias("skip"), (end - begin).alias("words"))

    def spans(self) -> DataFrame:
        """shard, slot, at, row, doc_id, source, skip, words: what each slot takes of which document."""
        slots = self.slots().select("shard", "slot", "source", "block", F.col("words").alias("most"))
        taken = F.least("words", F.col("most") - F.col("at"))
        return self.pieces().join(slots, ["source", "block"]).where("at < most").select("shard", "slot", "at", "row", "doc_id", "source", "skip", taken.alias("words"))

    def report(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per row."""
        every = self.documents().select("row", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
        zero = F.lit(None).cast("long")
        both = every.unionByName(self.spans().select("row", zero.alias("doc_id"), "source", zero.alias("size"), F.col("words").alias("taken")))
        whole = both.groupBy("row", "source").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
        named = whole.join(F.broadcast(self._sources().drop("source_name")), "source")
        return named.select("doc_id", "size", "source_size", "target", "taken")

    def texts(self) -> DataFrame:
        """shard, slot, text: the words of each slot, with single spaces. A text is dealt to its place
        and cut there; pieces meet their slots by source and block. A slot has at most ``block`` words."""
        plain = pick(self.docs, "doc_id", "text", "source", doc_id="long", text="string", source="string").withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))
        rows = self._numbered(plain.where("size > 0")).select("source", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", F.xxhash64("text").alias("tie"), "text")
        cut = self._placed(rows, "text string, ", "placed-texts").select("source", "text", "start").transform(in_batches, _word_pieces(self.block), "source int, block long, at long, piece string")
        slots = self.slots().select("shard", "slot", "source", "block", F.col("words").alias("most"))
        met = cut.join(slots, ["source", "block"]).where("at < most")
        whole = met.groupBy("shard", "slot", "most").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
        words = F.split(F.concat_ws(" ", F.col("p.piece")), " ")
        return whole.select("shard", "slot", F.array_join(F.slice(words, F.lit(1), F.col("most").cast("int")), " ").alias("text"))


def _word_pieces(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, text, start in zip(b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("start").to_pylist()):
                words, rows, at = text.split(), [], 0
                while at < len(words):
                    n, off = divmod(start + at, block)
                    some = words[at : at + block - off]
                    rows.append((source, n, off, b" ".join(some).decode()))
                    at += len(some)
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], names=["source", "block", "at", "piece"])

    return run


def write_mix(mix: Mix, path: str) -> DataFrame:
    """The mixed texts as Parquet, a folder a shard; read back."""
    out = mix.texts()
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return mix.spark.read.parquet(path)

