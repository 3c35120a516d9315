"""Language ID by a linear-chain conditional random field over the words of a text.

Words are runs of letters. A word's features are its prefix and suffix of up to three letters,
its letter bigrams and trigrams with marks at both ends, and whether it is in the lexicon of
frequent training words; all but the lexicon are hashed into one table of weights. Transitions
between the labels of neighbouring words are learned from spliced runs of words in different
languages, so words of code-switched text get labels of their own. Marginals come from
forward-backward over the whole text: the words are laid out in segments whose transfer
matrices are multiplied in parallel, so a very long text takes no longer path than a short one.

A text's language has the largest mean marginal over its words, which is the score; of equals,
the first by name. Null texts and texts without letters are ``und`` with score 0. Without any
labelled row everything is ``und``.

The model is fitted on the driver on a sample of about ``sample_rows`` labelled rows, taken by
hash, evenly over the labels; rows of over ``longest`` characters are not sampled, and rows whose
crc32 of the doc_id mod 4 is 2 are held out: their labels are never read. The sample is
the only bound: every row, whole, gets a prediction.
"""

from __future__ import annotations

import functools
import random
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, in_batches, keep_where, pick

SAMPLE_ROWS = 800
LONGEST = 100_000
TABLE = 1 << 16
LEXICON = 4000
SEGMENT = 128
UNKNOWN = "und"
_EDGE = np.uint32(7)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter and its lower case if that is one character."""
    n = sys.maxunicode + 1
    alpha = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(alpha).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return alpha, lower


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)


@dataclass
class Words:
    """The words of several texts, one after the other."""

    points: np.ndarray  # lower-cased code points of all words, marked at both ends
    first: np.ndarray  # where each word begins in points (its mark)
    sizes: np.ndarray  # letters of each word
    text: np.ndarray  # text of each word
    start: np.ndarray  # offset of each word in its text


def split_words(texts: list[str]) -> Words:
    alpha, lower = _letters()
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = alpha[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_letter, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sizes = end - begin
    first = np.cumsum(sizes + 2) - (sizes + 2)
    points = np.full(int((sizes + 2).sum()), _EDGE, np.uint32)
    inside = np.ones(len(points), bool)
    inside[first] = inside[first + sizes + 1] = False
    points[inside] = lower[raw[is_letter]]
    bases = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(bases, begin, side="right") - 1
    return Words(points, first, sizes, text, begin - bases[text])


def word_hashes(w: Words) -> np.ndarray:
    """A 32-bit hash of each whole word."""
    if not len(w.sizes):
        return np.zeros(0, np.uint32)
    place = np.arange(len(w.points)) - np.repeat(w.first, w.sizes + 2)
    return _mix(np.add.reduceat(_mix(w.points + np.uint32(31) * place.astype(np.uint32)), w.first))


def gram_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and trigram features by position of points; a word's are those from its mark on.

    Grams that would reach over a word's end get the slot of no weight, zero.
    """
    p = w.points
    two = np.zeros(len(p), np.uint32)
    three = np.zeros(len(p), np.uint32)
    two[:-1] = _mix(p[:-1] * np.uint32(65599) + p[1:] + np.uint32(2)) % np.uint32(TABLE - 1) + 1
    three[:-2] = _mix(_mix(p[:-2] * np.uint32(65599) + p[1:-1]) + p[2:] + np.uint32(3)) % np.uint32(TABLE - 1) + 1
    last = w.first + w.sizes + 1
    two[last] = three[last] = three[last - 1] = 0
    return two.astype(np.int32), three.astype(np.int32)


def affix_features(w: Words) -> np.ndarray:
    """(words, 6): prefixes and suffixes of one to three letters; zero where a word is shorter."""
    out = np.zeros((len(w.sizes), 6), np.int32)
    for side in (0, 1):
        h = np.full(len(w.sizes), 11 + side, np.uint32)
        for k in range(3):
            has = w.sizes > k
            at = np.where(has, w.first + 1 + k if side == 0 else w.first + w.sizes - k, 0)
            h = _mix(h + w.points[at])
            out[:, 3 * side + k] = np.where(has, h % np.uint32(TABLE - 1) + 1, 0)
    return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (TABLE, labels); row 0 is zero
    known: np.ndarray  # sorted hashes of the lexicon
    lexicon: np.ndarray  # (len(known) + 1, labels); the last row is zero
    moves: np.ndarray  # (labels, labels) log potentials
    begin: np.ndarray  # (labels,)

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.sizes):
            return np.zeros((0, len(self.labels)), np.float32)
        two, three = gram_features(w)
        out = np.add.reduceat(self.weights[two] + self.weights[three], w.first, axis=0)
        affix = affix_features(w)
        for k in range(6):
            out += self.weights[affix[:, k]]
        return out + self.lexicon[self._entries(w)]

    def _entries(self, w: Words) -> np.ndarray:
        h = word_hashes(w)
        if not len(self.known):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, len(self.known))


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Forward-backward over texts laid end to end. e: (words, labels) log potentials; lengths:
    words of each text, all positive. Returns the marginals of each word's labels."""
    return forward_backward(e, lengths, moves, begin, segment)[0]


def forward_backward(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: np.ndarray, segment: int, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and with ``pairs`` (every text in one segment) the expected number of times
    that each label follows each other one, summed over all texts; else zeros."""
    n, k = e.shape
    psi = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64)
    move, start = np.exp(moves - moves.max()), np.exp(begin - begin.max())
    per = -(-lengths // segment)
    rows = int(per.sum())
    row0 = np.cumsum(per) - per
    index = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = np.repeat(row0, lengths) + index // segment, index % segment
    width = int(min(segment, lengths.max()))
    grid = np.ones((rows, width, k))
    grid[row, col] = psi
    real = np.zeros((rows, width), bool)
    real[row, col] = True
    head = np.zeros(rows, bool)
    head[row0] = True

    def unit(x: np.ndarray, axes=-1) -> np.ndarray:
        return x / x.sum(axis=axes, keepdims=True)

    transfer = np.zeros((rows, k, k))
    chained = np.repeat(per > 1, per)
    if chained.any():
        m = np.broadcast_to(np.eye(k), (int(chained.sum()), k, k)).copy()
        own, g, r = head[chained], grid[chained], real[chained]
        for t in range(width):
            step = m @ move if t else np.where(own[:, None, None], m, m @ move)
            m = np.where(r[:, t, None, None], unit(step * g[:, t, None, :], (1, 2)), m)
        transfer[chained] = m
    enter, leave = np.tile(start, (rows, 1)), np.ones((rows, k))
    for j in range(1, int(per.max())):
        at = row0[per > j] + j
        enter[at] = unit(np.einsum("ri,rij->rj", enter[at - 1], transfer[at - 1]))
    for j in range(int(per.max()) - 2, -1, -1):
        at = row0[per > j + 1] + j
        leave[at] = unit(np.einsum("rij,rj->ri", transfer[at + 1], leave[at + 1]))
    alpha = np.empty((width, rows, k))
    a = enter
    for t in range(width):
        step = a @ move if t else np.where(head[:, None], a, a @ move)
        a = np.where(real[:, t, None], unit(step * grid[:, t]), a)
        alpha[t] = a
    if pairs and (per > 1).any():
        raise ValueError("a text is longer than the segment")
    out = np.empty((rows, width, k))
    moved = np.zeros((k, k))
    b = leave
    for t in range(width - 1, -1, -1):
        out[:, t] = alpha[t] * b
        own = grid[:, t] * b
        if pairs and t:
            moved += unit(alpha[t - 1][:, :, None] * move * own[:, None, :], (1, 2))[real[:, t]].sum(axis=0)
        b = np.where(real[:, t, None], unit(own @ move.T), b)
    return unit(out[row, col]), moved


def fit(samples: list[tuple[str, str]], epochs: int = 4, seed: int = 1, rate: float = 0.25, decay: float = 1e-6) -> Model | None:
    """samples: (text, label). Maximises the conditional likelihood of word labels by Adagrad."""
    labels = sorted({label for _, label in samples})
    if not labels:
        return None
    k = len(labels)
    rng = random.Random(seed)
    runs: list[tuple[str, int]] = []  # pieces of 5 to 60 words, covering every sampled text
    counts: Counter[str] = Counter()
    for text, label in samples:
        held = text.split()
        counts.update(w.lower().strip(".,;:!?|()\"'") for w in held)
        at = 0
        while at < len(held):
            n = rng.randint(5, 60)
            runs.append((" ".join(held[at : at + n]), labels.index(label)))
            at += n
    frequent = [w for w, n in counts.most_common(LEXICON) if n > 1 and w.isalpha()]
    known = np.unique(word_hashes(split_words(frequent))) if frequent else np.zeros(0, np.uint32)
    model = Model(labels, np.zeros((TABLE, k), np.float32), known, np.zeros((len(known) + 1, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if k == 1:
        return model
    squares = [np.full_like(x, 1e-2) for x in (model.weights, model.lexicon, model.moves, model.begin)]
    rng.shuffle(runs)
    for _ in range(epochs):
        # Each sequence splices one to three runs, whatever their languages.
        sequences, at = [], 0
        while at < len(runs):
            n = rng.randint(1, 3)
            sequences.append(runs[at : at + n])
            at += n
        for lo in range(0, len(sequences), 200):
            part = sequences[lo : lo + 200]
            pieces = [p for s in part for p in s]
            w = split_words([t for t, _ in pieces])
            if not len(w.sizes):
                continue
            gold = np.array([g for _, g in pieces])[w.text]
            of = np.repeat(np.arange(len(part)), [len(s) for s in part])[w.text]
            lengths = np.bincount(of)
            lengths = lengths[lengths > 0]
            e = model.emissions(w)
            p, moved = forward_backward(e, lengths, model.moves, model.begin, int(lengths.max()), True)
            g = (np.eye(k)[gold] - p).astype(np.float32)
            two, three = gram_features(w)
            word = np.repeat(np.arange(len(w.sizes)), w.sizes + 2)
            affix, entry = affix_features(w), model._entries(w)
            slots = np.concatenate([two, three, affix.T.reshape(-1)])
            whose = np.concatenate([word, word, np.tile(np.arange(len(w.sizes)), 6)])
            d_weights = np.stack([np.bincount(slots, weights=g[whose, j], minlength=TABLE) for j in range(k)], 1)
            d_weights[0] = 0
            d_lexicon = np.stack([np.bincount(entry, weights=g[:, j], minlength=len(known) + 1) for j in range(k)], 1)
            d_lexicon[-1] = 0
            starts = np.cumsum(lengths) - lengths
            inner = np.setdiff1d(np.arange(len(gold)), starts)
            d_moves = np.zeros((k, k))
            np.add.at(d_moves, (gold[inner - 1], gold[inner]), 1)
            d_moves -= moved
            d_begin = (np.eye(k)[gold[starts]] - p[starts]).sum(axis=0)
            for x, d, s in zip((model.weights, model.lexicon, model.moves, model.begin), (d_weights, d_lexicon, d_moves, d_begin), squares):
                d = d / len(part) - decay * x
                s += d * d
                x += rate * d / np.sqrt(s)
    return model


def sample_labelled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, longest: int = LONGEST) -> list[tuple[str, str]]:
    """About sample_rows rows of (text, lang), evenly over the labels, taken by hash."""
    rows = pick(docs, "doc_id", "text", "lang", doc_id="long", text="string", lang="string")
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return []
    share = max(1, sample_rows // len(counts))
    top = float(1 << 63)
    cut = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, share / r["n"]) * (top - 1024))))))
    taken = usable.withColumn("h", F.xxhash64("text", "doc_id")).where(F.shiftrightunsigned("h", 1) <= cut[F.col("lang")]).orderBy("h").limit(2 * sample_rows + 100).collect()
    by: dict[str, list[str]] = defaultdict(list)
    for r in taken:
        if len(by[r["lang"]]) < 2 * share:
            by[r["lang"]].append(r["text"])
    return [(t, label) for label, texts in by.items() for t in dict.fromkeys(texts)]


def text_scores(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    w = split_words([t or "" for t in texts])
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if len(w.sizes):
        lengths = np.bincount(w.text, minlength=len(texts))
        some = np.flatnonzero(lengths)
        p = marginals(model.emissions(w), lengths[some], model.moves, model.begin)
        mean = np.add.reduceat(p, np.cumsum(lengths[some]) - lengths[some], axis=0) / lengths[some, None]
        best = np.round(mean, 9).argmax(axis=1)
        for at, j, row in zip(some.tolist(), best.tolist(), mean):
            labels[at], scores[at] = model.labels[j], min(1.0, float(row[j]))
    return labels, scores


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = b.column("text").to_pylist()
            if model is None:
                labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                labels, scores = [], []
                for part in _parts(texts):
                    got = text_scores(model, part)
                    labels += got[0]
                    scores += got[1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def _parts(texts: list[str | None], limit: int = 400_000) -> Iterator[list[str | None]]:
    """Runs of texts of about limit characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    return fit(sample_labelled(docs, sample_rows))


def predict_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: one row per row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return documents(docs).transform(in_batches, _predict(held), "doc_id long, lang_pred string, score double")


def keep_known_language(docs: DataFrame, model: Model | None, least_score: float) -> DataFrame:
    """The rows, all columns kept, whose text has a known language with at least that score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        if held.value is None:
            return pd.Series(False, index=texts.index)
        got = [x for part in _parts([t if isinstance(t, str) else None for t in texts]) for x in zip(*text_scores(held.value, part))]
        give_back()
        return pd.Series([label != UNKNOWN and score >= least_score for label, score in got], index=texts.index, dtype=bool)

    return keep_where(docs, known, "text")


def language_spans(model: Model, text: str | None) -> list[tuple[int, int, str, float]]:
    """Runs of words with one label: (start, end, label, mean marginal) by character offsets."""
    w = split_words([text or ""])
    if not len(w.sizes):
        return []
    p = marginals(model.emissions(w), np.array([len(w.sizes)]), model.moves, model.begin)
    label = p.argmax(axis=1)
    cuts = np.flatnonzero(np.diff(label)) + 1
    out = []
    for run in np.split(np.arange(len(label)), cuts):
        j = int(label[run[0]])
        out.append((int(w.start[run[0]]), int(w.start[run[-1]] + w.sizes[run[-1]]), model.labels[j], float(p[run, j].mean())))
    return out
