"""SimHash near-dedup: 64-bit fingerprints and a binary trie self-join.

Fingerprints are grouped first, so copies cost nothing further. Of ``n`` blocks of bits, two
fingerprints within ``budget`` differing bits agree in full on at least ``n - budget``; for each
such choice of blocks the bits are reordered so that these lead, and fingerprints are dealt out
by them. n grows with the number of fingerprints (see choose_blocks). Within a
group the trie over the sorted fingerprints is joined with itself: pairs of nodes descend
together, differing bits add up, and a pair is dropped once they exceed the budget. A node is a
range of the sorted array, so a level of many pairs is one numpy step; where they grow too many
they are halved and joined one half after the other. Links between neighbours in the sorted order
are taken first, and a pair of nodes whose fingerprints are all in one component already is
dropped, so dense groups cost no square. Groups of more than
``part_rows`` are cut into hashed parts and every pair of parts becomes its own task, so no
task holds a large group and none of its links is lost. Each task returns a spanning star for
each of its components, never all pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer words than a
shingle has one shingle, the whole sequence; null and empty texts have fingerprint zero and
are linked like any other.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_at, documents, group_bounds, in_batches, least_partitions, plain_names, stash, whole_groups
from .components import connected_components
from .members import member_filter, passes
from .occurrences import doc_key

#: Rows of a group up to which more of them cost less than more tables of rows.
GROUP_ROWS = 1500
#: Rows of a group that meet in one task; larger ones are cut.
PART_ROWS = 8192
#: Rows squared of the groups that are joined together.
_SLAB = 8_000_000
#: Node pairs of one step, and index pairs held before they are merged into components.
_WIDE = 1 << 18
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = bytes(32 if i in b"\t\n\x0b\x0c\r" else x for i, x in enumerate(_LOWER))


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or b"").translate(_SPACE).split(b" ")
    if not all(words):
        words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - shingle + 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, shingle, seed) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return run


def _keyed_fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, shingle, seed) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), pa.array(got.view(np.int64))], names=["doc", "h", "fp"])

    return run


def simhash(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row."""
    return documents(docs).transform(in_batches, _fingerprints(shingle, seed), "doc_id long, fp long")


class Groups:
    """Components of indices that are known to be linked."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.label = _labels(len(self.label), self.label[i], self.label[j])[self.label]

    def settled(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs of ranges lie in one component as a whole."""
        turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        whole = (turns[pairs[:, 1] - 1] == turns[pairs[:, 0]]) & (turns[pairs[:, 3] - 1] == turns[pairs[:, 2]])
        return whole & (self.label[pairs[:, 0]] == self.label[pairs[:, 2]])


def trie_pairs(keys: np.ndarray, roots: list[tuple[int, int, int, int]], start: int, budget: int, groups: Groups | None = None, near=None, merge: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Joins tries over ``keys`` (uint64; each root range is sorted and shares its first
    ``start`` bits). roots: (lo, hi, lo, hi) of the two sides; equal sides are a self-join.
    Returns the index pairs within ``budget`` differing bits of which ``near(i, j)`` is true, if given
    (a mask or the places of those pairs).

    With ``groups``, pairs inside a known component are left out; with ``merge`` what is found
    joins components on the way, so that the pairs, together with those known, only span them."""
    ones: dict[int, np.ndarray] = {}
    found: list[np.ndarray] = []
    fresh: list[np.ndarray] = []

    def leaves(p: np.ndarray) -> None:
        wide, tall = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        n = wide * tall
        of = np.repeat(np.arange(len(p)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, j = p[of, 0] + k // tall[of], p[of, 2] + k % tall[of]
        ok = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & ((p[of, 0] != p[of, 2]) | (i < j))
        i, j = i[ok], j[ok]
        if groups is not None:
            ok = groups.label[i] != groups.label[j]
            i, j = i[ok], j[ok]
        if near is not None:
            ok = near(i, j)
            i, j = i[ok], j[ok]
        if len(i):
            found.append(np.stack([i, j]))
            fresh.append(found[-1])
        if groups is not None and merge and sum(x.shape[1] for x in fresh) > _WIDE:
            groups.link(*np.concatenate(fresh, axis=1))
            fresh.clear()

    first = np.array(roots, np.int64).reshape(-1, 4)
    first = first[(first[:, 1] > first[:, 0]) & (first[:, 3] > first[:, 2])]
    todo = [(start, first, np.zeros(len(first), np.int8))]
    while todo:
        depth, pairs, error = todo.pop()
        if groups is not None and len(pairs):
            open_ = ~groups.settled(pairs)
            pairs, error = pairs[open_], error[open_]
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 12
        if small.any():
            leaves(pairs[small])
            pairs, error = pairs[~small], error[~small]
        if not len(pairs):
            continue
        if depth == 64:  # equal keys, many of them
            for p in pairs:
                for at in range(p[0], p[1], max(1, _WIDE // (p[3] - p[2]))):
                    upto = min(p[1], at + max(1, _WIDE // (p[3] - p[2])))
                    if p[0] != p[2]:
                        leaves(np.array([[at, upto, p[2], p[3]]]))
                    else:
                        leaves(np.array([[at, upto, at, upto]]))
                        if upto < p[1]:
                            leaves(np.array([[at, upto, upto, p[1]]]))
            continue
        if len(pairs) > _WIDE:
            half = len(pairs) // 2
            todo += [(depth, pairs[half:], error[half:]), (depth, pairs[:half], error[:half])]
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        held = ones[depth]
        a0, a2, b0, b2 = pairs.T
        a1, b1 = a2 - (held[a2] - held[a0]), b2 - (held[b2] - held[b0])
        same = a0 == b0
        parts = [
            (np.stack([a0, a1, b0, b1], 1), error),
            (np.stack([a1, a2, b1, b2], 1), error),
            (np.stack([a0, a1, b1, b2], 1), error + 1),
            (np.stack([a1, a2, b0, b1], 1)[~same], error[~same] + 1),
        ]
        pairs, error = np.concatenate([p for p, _ in parts]), np.concatenate([e for _, e in parts])
        alive = (error <= budget) & (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])
        todo.append((depth + 1, pairs[alive], error[alive]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(found, axis=1)
    return i, j


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def neighbour_links(keys: np.ndarray, bounds: np.ndarray, budget: int, near=None, reach: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs up to ``reach`` places apart in one range of ``bounds`` that are within the budget."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) if len(bounds) > 1 else np.zeros(0, np.int64)
    out = []
    for step in range(1, min(reach, len(keys) - 1) + 1):
        i = np.flatnonzero((of[step:] == of[:-step]) & (np.bitwise_count(keys[step:] ^ keys[:-step]) <= budget))
        out.append(np.stack([i, i + step]))
    i, j = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    ok = near(i, j) if near is not None else slice(None)
    return i[ok], j[ok]


def _slab_stars(keys: np.ndarray, cuts: list[tuple[int, int, int]], start: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = cuts[0][0], cuts[-1][2]
    keys = keys[low:high]
    roots = [(lo - low, hi - low, lo - low, hi - low) if mid < 0 else (lo - low, mid - low, mid - low, hi - low) for lo, mid, hi in cuts]
    groups = Groups(len(keys))
    groups.link(*neighbour_links(keys, np.array([0, *(hi - low for _, _, hi in cuts)]), budget))
    groups.link(*trie_pairs(keys, roots, start, budget, groups))
    away = np.flatnonzero(groups.label != np.arange(len(keys)))
    return away + low, groups.label[away] + low


def _stars(start: int, budget: int):
    """Tasks arrive sorted by (block, lead, left, right, side, key): the group and its pair of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, slab in slabs(batches):
            key, fp = table.column("key").to_numpy().view(np.uint64), table.column("fp").to_numpy()
            u, v = _slab_stars(key, slab, start, budget)
            yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], names=["u", "v"])

    return run


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int, int]]]]:
    """Tables of whole groups of a task (see deal), with runs of groups to be joined together:
    (begin, begin of the second side or -1, end), one after the other."""
    names = ("block", "lead", "left", "right")
    for table in whole_groups(batches, names, 100_000):
        side = table.column("side").to_numpy()
        cuts = group_bounds(table, names)
        turn = np.concatenate([[0], np.cumsum(side)])
        two = table.column("left").to_numpy()[cuts[:-1]] != table.column("right").to_numpy()[cuts[:-1]]
        groups, work = [], 0
        for lo, hi, own, cross in zip(cuts[:-1].tolist(), cuts[1:].tolist(), (turn[cuts[1:]] - turn[cuts[:-1]]).tolist(), two.tolist()):
            groups.append((lo, hi - own if cross else -1, hi))
            work += (hi - lo) ** 2
            if work > _SLAB:
                yield table, groups
                groups, work = [], 0
        if groups:
            yield table, groups


def _blocks(n: int) -> list[tuple[int, int]]:
    """(offset, width) of n blocks over 64 bits."""
    edges = [round(k * 64 / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def choose_blocks(rows: int, budget: int, group_rows: int) -> int:
    """How many blocks to cut 64 bits into. Of n blocks, pairs agree on some n - budget; each such
    choice is one table of all rows, dealt by the bits of its blocks. More blocks mean more tables
    but smaller groups; the least number of copies of a row wins. All choices find the same links."""

    def copies(n: int) -> float:
        group = rows / 2.0 ** (64 * (n - budget) // n)
        return math.comb(n, budget) * max(1.0, group / group_rows)

    return min(range(budget + 1, budget + 6), key=lambda n: (copies(n), n))


def _slice(offset: int, width: int, at: int) -> Column:
    """The bits [offset, offset + width) of fp, from the top, moved to begin at bit ``at``."""
    low = F.shiftrightunsigned(F.shiftleft("fp", offset), 64 - width)
    return F.shiftleft(low, 64 - width - at)


def deal(rows: DataFrame, part_rows: int, *order: str) -> DataFrame:
    """rows: block, lead (together the group), fp and more. Adds left, right and side: the pair of
    parts of the group that meet, in whole groups sorted by side and ``order``."""
    large = rows.groupBy("block", "lead").agg(F.count("*").alias("n_")).where(F.col("n_") > part_rows).select("block", "lead", F.ceil(F.col("n_") / part_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    parted = rows.join(large, ["block", "lead"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    more = [c for c in rows.columns if c not in ("block", "lead")]
    tasks = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "lead", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), (F.col("part") > F.col("other")).cast("int").alias("side"), *more)
    n = least_partitions(rows.sparkSession)
    return tasks.repartition(n, "block", "lead", "left", "right").sortWithinPartitions("block", "lead", "left", "right", "side", *order)


def near_links(fps: DataFrame, budget: int = 4, group_rows: int = GROUP_ROWS, blocks: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """fps: distinct fingerprints in ``fp``. Returns (u, v) links that span every component of
    the graph whose edges are all pairs within ``budget`` bits."""
    cut = _blocks(blocks or choose_blocks(fps.count(), budget, group_rows))
    tables, start = [], 64
    for k, leading in enumerate(itertools.combinations(range(len(cut)), len(cut) - budget)):
        order = [cut[b] for b in leading] + [cut[b] for b in range(len(cut)) if b not in leading]
        at = list(itertools.accumulate((w for _, w in order), initial=0))
        key = functools.reduce(lambda a, b: a.bitwiseOR(b), (_slice(off, width, place) for (off, width), place in zip(order, at)))
        start = min(start, at[len(leading)])
        tables.append(F.struct(F.lit(k).alias("block"), key.alias("key"), F.shiftrightunsigned(key, 64 - at[len(leading)]).alias("lead")))
    rows = fps.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.*")
    dealt = deal(rows, part_rows, "key")
    return dealt.transform(in_batches, _stars(start, budget), "u long, v long")


def _classes(held: DataFrame, budget: int, group_rows: int, scope: str, roots: DataFrame | None = None) -> DataFrame:
    """held: doc_id, fp; roots: (node, root) of linked fps, by default those within the budget.
    Returns fp, component_id."""
    least = stash(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct", scope)
    if roots is None:
        roots = connected_components(near_links(least.select("fp"), budget, group_rows), scope)
    classes = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(named, "root").select("fp", "component_id")


def simhash_dedup(docs: DataFrame, budget: int = 4, shingle: int = 4, seed: int = 42, group_rows: int = GROUP_ROWS, scope: str = "default") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links, its own included.

    One row per row; repeated rows and equal doc_ids share the component of their fingerprint.
    A null doc_id takes part but is never a component's id unless it is all the component has.
    """
    held = stash(simhash(docs, shingle, seed), "simhash", scope)
    return held.join(_classes(held, budget, group_rows, scope), "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, budget: int = 4, shingle: int = 4, seed: int = 42, group_rows: int = GROUP_ROWS, scope: str = "default", similarity: float | None = None) -> DataFrame:
    """The table, all columns kept, with one document of each group of near-duplicates: the
    smallest doc_id (null last); of rows that repeat it, the smallest hash of the text; of rows
    that repeat both, any one. Only rows that may go are shuffled. With a ``similarity``, groups
    are linked by it, of five-word shingles (see near_dedup), not by differing bits alone."""
    from .near_dedup import fingerprinted, similar_roots

    spark = docs.sparkSession
    source = documents(docs).withColumn("doc", doc_key(F.col("doc_id"))).withColumn("h", F.xxhash64("text")).select("doc", "h", "text")
    if similarity is None:
        held, roots = stash(source.transform(in_batches, _keyed_fingerprints(shingle, seed), "doc long, h long, fp long"), "simhash", scope), None
    else:
        held = stash(fingerprinted(source), "wide-simhash", scope)
        roots = similar_roots(held, source, scope, similarity)
    classes = _classes(held.select(F.col("doc").alias("doc_id"), "fp"), budget, group_rows, scope, roots)
    keyed = held.groupBy("doc", "h", "fp").agg(F.count("*").alias("copies")).join(classes, "fp")
    stays = keyed.where("doc = component_id").groupBy("component_id").agg(F.min("h").alias("h0"))
    judged = keyed.join(stays, "component_id").withColumn("stays", (F.col("doc") == F.col("component_id")) & (F.col("h") == F.col("h0")))
    gone = stash(judged.where("not stays or copies > 1").select("doc", "h", "stays"), "simhash-gone", scope)
    bits = spark.sparkContext.broadcast(member_filter(gone.select(F.xxhash64("doc", "h"))))

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, keys.to_numpy(np.int64)), index=keys.index)

    plain, names = plain_names(docs)
    plain = plain.withColumn("__doc", doc_key(F.col(column_at(docs, "doc_id")).cast("long"))).withColumn("__h", F.xxhash64(F.col(column_at(docs, "text")).cast("string")))
    plain = plain.withColumn("__may", may(F.xxhash64("__doc", "__h")))
    candidates = plain.where("__may").join(gone, (F.col("__doc") == F.col("doc")) & (F.col("__h") == F.col("h")), "left").where("stays is null or stays")
    once = candidates.where("stays").dropDuplicates(["__doc", "__h"])
    kept = plain.where("not __may").select(*names).unionByName(candidates.where("stays is null").select(*names)).unionByName(once.select(*names))
    return kept.toDF(*docs.columns)
