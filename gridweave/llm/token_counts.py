"""Token counts by offset-mapped attribution.

Each document is encoded whole and once. The character spans of its tokens come from the ids
(every id of a byte-level vocabulary stands for a fixed number of UTF-8 bytes) and are
interval-joined with the sections of the document, sorted, in one pass. A token that crosses a
boundary belongs to the section that holds its first byte (``rule="start"``), to the section
that holds most of its bytes, the earlier of equals (``rule="most"``).

Sections are the lines of a text with their line ends; named fields can be given as spans
instead. Null and empty texts have no tokens and no sections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_batches, pick, small_batches
from .tokens import default_tokenizer, encoder, token_bytes


def attribute(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section. ids: of one text; sizes: bytes by id; sections: sorted, disjoint
    byte spans [starts, ends). Tokens that begin (or mostly lie) outside any are not counted."""
    stop = np.cumsum(sizes[ids])
    begin = stop - sizes[ids]
    if not len(starts) or not len(ids):
        return np.zeros(len(starts), np.int64)
    first = np.searchsorted(starts, begin, side="right") - 1
    if rule == "start":
        own = first
        inside = (own >= 0) & (begin < ends[np.maximum(own, 0)])
    elif rule == "most":
        last = np.searchsorted(starts, stop, side="left") - 1
        own, best = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        for step in range(int((last - first).max()) + 1):
            k = first + step
            ok = (k >= 0) & (k <= last)
            at = np.clip(k, 0, len(starts) - 1)
            share = np.where(ok, np.minimum(stop, ends[at]) - np.maximum(begin, starts[at]), 0)
            better = share > best
            own, best = np.where(better, k, own), np.where(better, share, best)
        inside = own >= 0
    else:
        raise ValueError(f"no rule {rule!r}")
    return np.bincount(own[inside], minlength=len(starts)).astype(np.int64)


def line_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text, each with its line end."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    starts = np.concatenate([[0], cuts[cuts < len(text)]])
    return starts, np.concatenate([starts[1:], [len(text)]])


def _sizes(path: str) -> np.ndarray:
    tok = encoder(path)
    if tok.token_bytes is None:
        tok.token_bytes = token_bytes(path)
    return tok.token_bytes


def _lines(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, sizes = encoder(path), _sizes(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            total, split = [], []
            for t, ids in zip(texts, tok.encode_batch(b.column("text"))):
                own = np.frombuffer(ids, "<u4")
                total.append(len(own))
                split.append(attribute(own, sizes, *line_spans((t or "").encode()), rule))
            lengths = np.cumsum([0, *map(len, split)])
            flat = np.concatenate(split) if split else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), lists], names=["doc_id", "n_tokens", "section_tokens"])

    return run


def line_token_counts(docs: DataFrame, rule: str = "start", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and section_tokens, the tokens of each line in order. One row per row."""
    return documents(docs).transform(in_batches, _lines(tokenizer or default_tokenizer(), rule), "doc_id long, n_tokens long, section_tokens array<long>")


def _fields(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, sizes = encoder(path), _sizes(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for t, doc_id, fields, ids in zip(texts, b.column("doc_id").to_pylist(), b.column("fields").to_pylist(), tok.encode_batch(texts)):
                spans = sorted((f["start"], f["end"], f["name"]) for f in fields or () if f and f["start"] is not None and f["end"] is not None and f["name"] is not None)
                text = t or ""
                at = np.cumsum([0, *(len(c.encode()) for c in text)]) if not text.isascii() else np.arange(len(text) + 1)
                edge = lambda x: int(at[min(max(x, 0), len(text))])
                starts, ends = np.array([edge(s) for s, _, _ in spans], np.int64), np.array([edge(e) for _, e, _ in spans], np.int64)
                for (_, _, name), n in zip(spans, attribute(np.frombuffer(ids, "<u4"), sizes, starts, ends, rule).tolist()):
                    out.append((doc_id, name, n))
            ids_, names, ns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(names, pa.string()), pa.array(ns, pa.int64())], names=["doc_id", "name", "n_tokens"])

    return run


def field_token_counts(docs: DataFrame, rule: str = "start", tokenizer: str | None = None) -> DataFrame:
    """docs: doc_id, text and fields, an array of (name, start, end) character spans that don't
    overlap. Returns doc_id, name, n_tokens for each field; spans with a null are left out."""
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "fields", doc_id="long", text="string", fields="array<struct<name:string,start:long,end:long>>")
    return rows.transform(in_batches, _fields(tokenizer or default_tokenizer(), rule), "doc_id long, name string, n_tokens long")
