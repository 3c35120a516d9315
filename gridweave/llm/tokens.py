"""Exact, fast encoding of whole texts with a byte-level BPE of the tokenizers library.

A byte-level pre-tokenizer always starts a new piece at a single space, or a single line end,
between two characters that are not white space. So a text is cut there, each distinct word is encoded by the library
once and remembered, and the whole is put together from the words' ids. A text in which a
space touches other white space, or begins or ends the text, is cut at other places by the
pre-tokenizer; such texts are encoded by the library as a whole, and so are texts that hold the
string of an added token, which the library takes as that token's id. The result is always equal
to ``Tokenizer.encode(text, add_special_tokens=False)`` of the whole text.

The memory is bounded by ``REMEMBERED`` words of at most ``LONGEST`` characters; the vocabulary
file's path is a parameter.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 800_000
LONGEST = 48
_MARKS = ".,;:!?"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = sorted({t.content for t in self.library.get_added_tokens_decoder().values()})
        pre = self.library.pre_tokenizer
        self.splits = "ByteLevel" in type(pre).__name__ and self.library.normalizer is None and self.library.post_processor is None and not pre.add_prefix_space
        self.token_bytes = token_bytes(path) if self.splits else None
        self.words, self.word_ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.marks: pa.Array | None = None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), 64) for e in self.library.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]

    def _encode_words(self, words: pa.Array) -> pa.Array:
        """The ids of words, each with what stands before it: many to a call, told apart by their bytes."""
        if not len(words):
            return pa.array([], pa.binary())
        # A few at a time: the library's results take many times the space of the ids.
        lots = [["".join(words[i : i + 1000].to_pylist()) for i in range(at, min(at + 8000, len(words)), 1000)] for at in range(0, len(words), 8000)]
        ids = np.concatenate([np.array(e.ids, "<u4") for lot in lots for e in self.library.encode_batch_fast(lot, add_special_tokens=False)])
        at = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(pc.binary_length(words).to_numpy())) + 1
        offsets = np.concatenate([[0], 4 * at]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])

    def _known(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words. Words not known are encoded and remembered; when too many are,
        the older half is forgotten."""
        at = pc.index_in(words, value_set=self.words)
        unknown = at.is_null()
        index = at.fill_null(0).to_numpy().astype(np.int64)
        new = words.filter(unknown)
        before = self.word_ids
        got = self._encode_words(new)
        index[unknown.to_numpy(zero_copy_only=False)] = len(before) + np.arange(len(new))
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        self.words, self.word_ids = pa.concat_arrays([self.words, new.filter(short)]), pa.concat_arrays([self.word_ids, got.filter(short)])
        if len(self.words) > REMEMBERED:
            self.words, self.word_ids = (pa.concat_arrays([x[len(x) // 2 :]]) for x in (self.words, self.word_ids))
        return pa.concat_arrays([before, got]).take(pa.array(index))

    def _by_stem(self, words: pa.Array) -> pa.Array:
        """The ids of words by those of their stems: a mark after an ASCII letter, at the end, is a
        piece of its own."""
        marked = pc.match_substring_regex(words, "[A-Za-z][.,;:!?]$")
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        own = self._known(stems.dictionary).take(stems.indices)
        if self.marks is None:
            self.marks = pa.array([*self._ids(list(_MARKS)), b""], pa.binary())
        place = pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array(list(_MARKS)))
        tail = self.marks.take(pc.if_else(marked, place, len(_MARKS)))
        return pc.binary_join_element_wise(own, tail, pa.scalar(b"", pa.binary()))

    def encode_batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """One entry per text; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "")
        if not len(column):
            return []
        if not self.splits:
            return self._ids(column.to_pylist())
        special = functools.reduce(pc.or_, [pc.match_substring(column, a) for a in self.added], pa.array([False] * len(column)))
        texts, column = column, pc.if_else(special, "", column)
        # Lines are cut off like words, but have no space before them.
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        first = at[:-1]
        words = coded.dictionary
        line = pc.starts_with(words, "\n")
        body = pc.if_else(line, pc.utf8_slice_codeunits(words, 1), words)
        # A piece that is empty or has white space at an end was not cut off at a boundary.
        bad = pc.or_(pc.equal(pc.binary_length(body), 0), pc.not_equal(pc.utf8_trim_whitespace(body), body))
        whole_words = pc.if_else(bad, " x", pc.if_else(line, words, pc.binary_join_element_wise("", words, " "))).dictionary_encode()
        table = self._by_stem(whole_words.dictionary)
        codes = coded.indices.to_numpy()
        heads = words.take(pa.array(codes[first])).to_pylist()
        index = whole_words.indices.to_numpy()[codes].astype(np.int64)
        # Beginnings of texts have no space before them.
        index[first] = len(table) + np.arange(len(column))
        flags = bad.to_numpy(zero_copy_only=False)[codes]
        flags[first] = [not h or h[-1].isspace() for h in heads]
        flat = pa.concat_arrays([table, pa.array(self._ids(heads), pa.binary())]).take(pa.array(index))
        offsets, data = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1), flat.buffers()[2].to_pybytes() if len(flat) and flat.buffers()[2] else b""
        bounds = offsets[at].tolist()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        cut_wrong = np.logical_or.reduceat(flags, first) & (at[1:] - first > 1)
        whole = np.flatnonzero(cut_wrong | special.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(whole, self._ids([texts[i].as_py() for i in whole])):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_bytes(path: str) -> np.ndarray:
    """The number of UTF-8 bytes that each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    vocabulary = library.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)  # one character a byte in byte-level vocabularies
    for i, token in library.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())  # added tokens are plain text
    return out
