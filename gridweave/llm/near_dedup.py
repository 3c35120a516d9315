"""Near-duplicates by word shingles: pairs whose sets of five-word shingles have a Jaccard
similarity of ``similarity`` or more, found by the trie join of wide SimHashes and then verified.

Two texts of similarity 0.8 have SimHashes that differ in 0.15 of their bits (the angle between
the sets over pi), so a budget of four bits does not do. The stage has fingerprints of 127 bits over the
distinct shingles and a budget of ``BUDGET`` bits. With so wide a budget, blocks that agree in full
would be a few bits wide; so rows are dealt by random choices of bits instead, as many choices of
as many bits as ``tables`` says for the number of texts: a pair at the similarity agrees on one of them with
probability 1 - ``MISS``. Within a group of equal chosen bits, tries are joined with themselves (see simhash),
between rows of similar size only: sets of unlike sizes can't be similar.

What the join links is verified by the exact similarity of the two texts. First each group's
components are linked as stars around the row nearest to the component's majority of bits, so a
large cluster costs no square; then all pairs within the budget that verified links leave in
different components are verified as well, if ``MORE`` further words of SimHash, which only the rows
that have a partner get, don't rule the similarity out. No group is capped.

Words are those of op4; a text of fewer words than a shingle has one shingle, the whole sequence;
null and empty texts are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stash
from .components import connected_components
from .line_dedup import grams_of
from .members import member_filter, passes
from .simhash import _SPACE, PART_ROWS, Groups, deal, neighbour_links, slabs, trie_pairs

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of 127. At similarity 0.8 there are 19 on average, with a deviation of 4.
BUDGET = 34
#: Share of bits that pairs at the similarity differ in; a little more than on average, as few
#: shingles give ties.
_DIFFER = 0.17
MISS = 1e-3
#: Rows that a group has on average.
GROUP_ROWS = 512
#: Ratio of sizes between buckets, a little over 1 / 0.8: similar sets lie in one or in neighbours.
_SIZES = 1.26
#: Further 64-bit words of SimHash, and the differing bits of all that rule a pair out: over three deviations
#: more than similarity 0.8 has (few shingles have more of them, by ties).
MORE = 32
_MOST, _MOST_OF_FEW, _FEW = 386, 440, 32
_SEEDS = np.random.default_rng(13).integers(1, 1 << 63, (MORE, 1), np.uint64) | np.uint64(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    return [w for w in (text or b"").translate(_SPACE).split(b" ") if w]


def node_of(words: list[bytes]) -> int:
    """What texts of equal words share, as a long."""
    h = xxhash.xxh64_intdigest(b" ".join(words), 11) if words else 0
    return h - (1 << 64) if h >> 63 else h


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashed shingles, sorted."""
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(grams_of(codes, min(shingle, max(1, len(words)))))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """64 booleans: the bits that over half of the hashes have set, from the top."""
    ones = np.zeros(64, np.int64)
    for k, column in enumerate(hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T):
        ones[8 * k : 8 * k + 8] = np.bincount(column, minlength=256) @ _BITS
    return 2 * ones > len(hashes)


def wide_fingerprint(held: np.ndarray) -> tuple[int, int]:
    """The SimHash of distinct shingle hashes: 63 bits and 64 bits."""
    other = held * np.uint64(0x9E3779B97F4A7C15)
    other ^= other >> np.uint64(32)
    other *= np.uint64(0xC2B2AE3D27D4EB4F)
    other ^= other >> np.uint64(29)
    high, low = (int.from_bytes(np.packbits(_majority(x)).tobytes(), "big") for x in (held, other))
    return high & ((1 << 63) - 1), low


def further_words(held: np.ndarray) -> bytes:
    """MORE words of SimHash of distinct shingle hashes."""
    ones = np.zeros((MORE, 64), np.int64)
    for at in range(0, len(held), 1024):
        x = held[at : at + 1024] * _SEEDS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(MORE, -1, 8), axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(held), axis=1).tobytes()


def tables(rows: int, miss: float = MISS, group_rows: int = GROUP_ROWS) -> tuple[int, int]:
    """(choices, bits of each) for so many rows: groups of about group_rows, and enough choices."""
    bits = max(3, math.ceil(math.log2(max(1, rows) / group_rows)))
    return math.ceil(math.log(miss) / math.log1p(-((1 - _DIFFER) ** bits))), bits


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            words = words_of(t)
            held = shingles(words)
            out.append((node_of(words), len(held), *wide_fingerprint(held)))
        node, n, high, low = zip(*out) if out else ((),) * 4
        bits = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("h"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), *bits], names=["doc", "h", "fp", "n", "high", "low"])


def fingerprinted(source: DataFrame) -> DataFrame:
    """source: doc, h, text. Returns doc, h, fp (the node), n (shingles), high and low (SimHash)."""
    return source.transform(in_batches, _fingerprinted, "doc long, h long, fp long, n long, high long, low long")


def _chosen(choices: int, bits: int) -> np.ndarray:
    """The places, of 128 from the top of high on, of each choice's bits; the top one is never set."""
    return np.stack([1 + np.random.default_rng([12, k]).choice(127, bits, replace=False) for k in range(choices)])


def _masks(choices: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each choice's bits as masks of high and of low."""
    each = np.zeros((choices, 128), np.uint8)
    np.put_along_axis(each, _chosen(choices, bits), 1, axis=1)
    return tuple(np.packbits(each, axis=1).view(">u8").astype(np.uint64).T)


def _leads(choices: int, bits: int):
    """The chosen bits of every choice."""
    at = _chosen(choices, bits)
    powers = np.int64(1) << np.arange(bits)

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(c).to_numpy() for c in ("high", "low")], 1).astype(">i8")
            each = np.unpackbits(words.view(np.uint8).reshape(-1, 16), axis=1)
            lead = (each[:, at].astype(np.int64) * powers).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * choices, pa.int32()), pa.array(lead.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "leads"])

    return do


def _grouped(nodes: DataFrame, choices: int, bits: int, part_rows: int) -> DataFrame:
    """nodes: fp, n, high, low and maybe root and more; every one once a choice, in groups (see deal)."""
    kinds = ", ".join(f"{c} {kind}" for c, kind in nodes.dtypes)
    led = nodes.transform(in_batches, _leads(choices, bits), f"{kinds}, leads array<long>")
    rows = led.select(F.posexplode("leads").alias("block", "lead"), *nodes.columns, F.floor(F.log("n") / math.log(_SIZES)).cast("int").alias("bucket"))
    return deal(rows, part_rows, "bucket", "high")


def _roots(slab: list[tuple[int, int, int]], bucket: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Root ranges of the groups: rows of one size bucket with those of it and of the next one."""
    out = []
    for lo, mid, hi in slab:
        sides = []
        for a, b in ((lo, hi),) if mid < 0 else ((lo, mid), (mid, hi)):
            edges = [a, *(a + 1 + np.flatnonzero(np.diff(bucket[a:b]))).tolist(), b]
            sides.append({int(bucket[x]): (x, y) for x, y in zip(edges, edges[1:]) if y > x})
        for k, own in sides[0].items():
            for other in (k, k + 1) if mid < 0 else (k - 1, k, k + 1):
                if other in sides[-1]:
                    out.append((*own, *sides[-1][other]))
    return out


def _centre(high: np.ndarray, low: np.ndarray, node: np.ndarray, member: np.ndarray) -> int:
    """The member nearest to the members' majority of bits; of equals the least node."""
    middle = [_majority(x[member]) for x in (high, low)]
    top, rest = (np.frombuffer(np.packbits(m).tobytes(), ">u8").astype(np.uint64)[0] for m in middle)
    away = np.bitwise_count(high[member] ^ top) + np.bitwise_count(low[member] ^ rest).astype(np.int64)
    return member[np.lexsort((node[member], away))[0]]


def _joined(budget: int, similarity: float, choices: int, bits: int, stars: bool):
    """Links (u, v) of nodes in a group: stars of the components, or all pairs of different roots,
    each by the first choice that both agree on."""
    of_high, of_low = _masks(choices, bits)

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, slab in slabs(batches):
            low_, high_ = slab[0][0], slab[-1][2]
            part = table.slice(low_, high_ - low_)
            node, n, bucket = (part.column(c).to_numpy() for c in ("fp", "n", "bucket"))
            high, low = (part.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            block = part.column("block").to_numpy()
            slab = [(lo - low_, mid if mid < 0 else mid - low_, hi - low_) for lo, mid, hi in slab]

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = (np.bitwise_count(high[i] ^ high[j]) + np.bitwise_count(low[i] ^ low[j]).astype(np.int64) <= budget) & (node[i] != node[j])
                return ok & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)  # noqa: B023

            def nearer(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = np.flatnonzero(near(i, j))
                p, q, own = high[i[ok]] ^ high[j[ok]], low[i[ok]] ^ low[j[ok]], block[i[ok]]  # noqa: B023
                for k in range(own.max(initial=0)):
                    new = (own <= k) | (p & of_high[k] | q & of_low[k] != 0)
                    ok, p, q, own = ok[new], p[new], q[new], own[new]
                i, j = i[ok], j[ok]
                away = np.bitwise_count(more[i] ^ more[j]).sum(axis=1, dtype=np.int64) + np.bitwise_count(high[i] ^ high[j]) + np.bitwise_count(low[i] ^ low[j])  # noqa: B023
                return ok[away <= np.where(np.minimum(n[i], n[j]) < _FEW, _MOST_OF_FEW, _MOST)]  # noqa: B023

            groups = Groups(len(node))
            if stars:
                groups.link(*neighbour_links(high, np.array([0, *(hi for _, _, hi in slab)]), budget, near))
                groups.link(*trie_pairs(high, _roots(slab, bucket), 1, budget, groups, near))
                order = np.argsort(groups.label, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups.label[order])) + 1, [len(order)]])
                u, v = [], []
                for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
                    member = order[cuts[k] : cuts[k + 1]]
                    centre = _centre(high, low, node, member)
                    v.append(member[member != centre])
                    u.append(np.full(len(member) - 1, centre))
                i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
            else:
                groups.label = np.unique(part.column("root").to_numpy(), return_inverse=True)[1]
                more = np.frombuffer(b"".join(part.column("more").to_pylist()), np.uint64).reshape(-1, MORE)
                i, j = trie_pairs(high, _roots(slab, bucket), 1, budget, groups, nearer, merge=False)
            u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            both = np.unique(np.stack([u, v]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    return do


def _wanted(bits):
    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([node_of(words_of(t)) for t in b.column("text").cast(pa.binary()).to_pylist()], np.int64)
            some = pa.array(np.flatnonzero(passes(bits.value, fp)) if len(fp) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(fp).take(some), b.column("text").take(some)], names=["fp", "text"])

    return do


def _alike(similarity: float):
    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for b in batches:
            near = []
            for s, t in zip(*(b.column(c).cast(pa.binary()).to_pylist() for c in ("text_u", "text_v"))):
                if last[0] != s:
                    last = (s, shingles(words_of(s)))
                near.append(jaccard(last[1], shingles(words_of(t))) >= similarity)
            some = pa.array(np.flatnonzero(near) if near else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("u").take(some), b.column("v").take(some)], names=["u", "v"])

    return do


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        more = [further_words(shingles(words_of(t))) for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(more, pa.binary())], names=["fp", "more"])


def _texts(links: DataFrame, source: DataFrame, scope: str) -> DataFrame:
    """fp, text of the nodes of some links (u, v); of a node's texts, the least."""
    ends = links.select("u").unionByName(links.select(F.col("v").alias("u")))
    bits = source.sparkSession.sparkContext.broadcast(member_filter(ends))
    texts = source.transform(in_batches, _wanted(bits), "fp long, text string").join(ends.distinct(), F.col("fp") == F.col("u"), "leftsemi")
    return stash(texts.groupBy("fp").agg(F.min("text").alias("text")), "near-texts", scope)


def _verified(links: DataFrame, texts: DataFrame, similarity: float, scope: str) -> DataFrame:
    """The links whose texts are as similar."""
    both = links.join(texts.select(F.col("fp").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("fp").alias("v"), F.col("text").alias("text_v")), "v")
    return stash(both.select("u", "v", "text_u", "text_v").transform(in_batches, _alike(similarity), "u long, v long"), "near-links", scope)


def similar_roots(held: DataFrame, source: DataFrame, scope: str, similarity: float = SIMILARITY, budget: int = BUDGET, part_rows: int = PART_ROWS) -> DataFrame:
    """held: see fingerprinted. Returns (node, root) of each fp that has a link to another one."""
    nodes = stash(held.where("n > 0").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "high", "low"))), "near-nodes", scope)
    choices, bits = tables(nodes.count())
    stars = stash(_grouped(nodes, choices, bits, part_rows).transform(in_batches, _joined(budget, similarity, choices, bits, True), "u long, v long").distinct(), "near-stars", scope)
    texts = _texts(stars, source, scope)
    roots = connected_components(_verified(stars, texts, similarity, scope), scope)
    # Who has no star has no one within the budget.
    some = texts.transform(in_batches, _further, "fp long, more binary").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "more", F.coalesce("root", "fp").alias("root"))
    left = stash(nodes.join(some, "fp").select("fp", "n", "high", "low", "root", "more"), "near-left", scope)
    pairs = _grouped(left, choices, bits, part_rows).transform(in_batches, _joined(budget, similarity, choices, bits, False), "u long, v long")
    pairs = stash(pairs.join(stars, ["u", "v"], "leftanti"), "near-pairs", scope)
    if pairs.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return connected_components(known.unionByName(_verified(pairs, texts, similarity, scope)), scope)
