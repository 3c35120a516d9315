"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to words (A-Z lower-cased, words are runs of characters
outside ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F``). Every run of ``window`` consecutive words of an item
is a pattern; an item of fewer words, but not none, is one pattern. The automaton's symbols are
words: an item's words are numbered, all others are symbol zero. Each text is scanned once;
matches give word positions, which map to character offsets of the original text.

Only the benchmark is broadcast, in blocks of at most ``block_words`` windows, long items cut into
overlapping parts; a benchmark of several blocks is scanned block by block with the matches of a
document carried along in its row, written between blocks. So one automaton is all that a worker
holds, the benchmark's size is never bounded by its memory, and nothing is shuffled.

A null text or item has no words. Rows are kept one for one, repeated rows included; an empty
benchmark leaves every document clean. Items with equal text match alike; a null item_id is
reported as an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, in_batches, keep_where, pick, plain_names, stash

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of UTF-8: what is not part of a word becomes a space, A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Windows of one automaton, which bounds a worker's memory: each makes at most ``window`` nodes, of about 80 bytes.
BLOCK_WORDS = 400_000


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Windows:
    """The automaton of one block of items: (item index, text bytes)."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.ids: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        owners: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            numbers = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in normal_words(text))
            n = min(window, len(numbers))
            for at in range(len(numbers) - n + 1 if n else 0):
                owners.setdefault(numbers[at : at + n], set()).add(k)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, own in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(own)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()
        self.shortest = min(map(len, owners), default=0)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [start, end) of all matches, and the items that have one."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if self.empty or len(words) < self.shortest:
            return spans, found
        get = self.ids.get
        for end, (n, own) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            spans.append((end - n + 1, end + 1))
            found.update(own)
        return spans, found


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint union of spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_built: dict[tuple, Windows] = {}


def _windows(block, window: int) -> Windows:
    """One automaton at a time is kept in a worker."""
    key = (block._path or id(block), window)
    if key not in _built:
        _built.clear()
        _built[key] = Windows(block.value, window)
    return _built[key]


def _scan(block, window: int, more: bool):
    """Adds a block's matches to the word spans and items in the row. more: further blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _windows(block, window)
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            before = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * len(texts)
            items_before = b.column("items").to_pylist() if "items" in b.schema.names else [None] * len(texts)
            n_words, spans, items, marks = [], [], [], []
            for t, old, held in zip(texts, before, items_before):
                words = normal_words(t)
                got, found = own.scan(words)
                if old:
                    got += list(zip(old[::2], old[1::2]))
                merged = join_spans(got)
                n_words.append(len(words))
                spans.append([x for s in merged for x in s])
                items.append(sorted({own.items[k] for k in found} | set(held or ())))
                marks.append([] if more or not merged else _offsets(t, merged))
            arrays = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            arrays += [b.column("text")] if more else [pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "spans", "items", "text" if more else "offsets"])

    return run


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """Character offsets of word spans in the original text: start, end, start, end, ..."""
    at = [m.span() for m in _WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text.decode()))]
    return [x for a, b in spans for x in (at[a][0], at[b - 1][1])]


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items, as their words, in blocks of at most block_words windows; a longer item is cut into parts
    that overlap by a window less one word, so all its windows are in some block."""
    items = pick(benchmark, "item_id", "text", item_id="string", text="string").where("text is not null").select(F.coalesce("item_id", F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in items.toLocalIterator():
        words = normal_words(bytes(r.text))
        for at in range(0, max(len(words) - window + 1, 1), block_words):
            part = words[at : at + block_words + window - 1]
            own = max(len(part) - window + 1, 1)
            if block and size + own > block_words:
                yield block
                block, size = [], 0
            block.append((r.item_id, b" ".join(part)))
            size += own
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, scope: str = "default") -> DataFrame:
    """One row per document: doc_id, n_words, spans (word spans, flat), items (sorted
    item_ids as strings), offsets (character spans of the original text, flat)."""
    spark = docs.sparkSession
    out = documents(docs)
    blocks = _blocks(benchmark, window, block_words)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        out = out.transform(in_batches, _scan(spark.sparkContext.broadcast(block), window, after is not None), "doc_id long, n_words long, spans array<long>, items array<string>, " + ("offsets array<long>" if after is None else "text string"))
        if after is not None:
            out = stash(out, "decontamination", scope)
        block = after
    return out


def contamination_report(found: DataFrame) -> DataFrame:
    """The digest columns of decontaminate()'s rows: n_hit counts the words inside matches."""
    hit = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("spans") / 2, F.lit(1)).cast("int")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("spans", 2 * i) - F.try_element_at("spans", 2 * i - 1), F.lit(0)))
    rows = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def _clean(block, window: int):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own = _windows(block, window)
        out = [not own.scan(normal_words(t.encode() if isinstance(t, str) else None))[0] for t in texts]
        give_back()
        return pd.Series(out, index=texts.index, dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, scope: str = "default") -> DataFrame:
    """The rows, all columns kept, in which no window of any item occurs."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark, window, block_words)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        docs = keep_where(docs, _clean(spark.sparkContext.broadcast(block), window), "text")
        if after is not None:  # written, so that a worker never has to hold or rebuild more than one automaton
            docs = stash(plain_names(docs)[0], "decontamination", scope).toDF(*docs.columns)
        block = after
    return docs
