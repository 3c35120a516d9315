import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridweave.llm import packing, tokens
from gridweave.llm.packing import pack, pack_histogram, slots
from gridweave.llm.token_counts import attribute, field_token_counts, line_spans, line_token_counts
from gridweave.llm.token_files import decode_block, encode_block, qualified, read_file, read_token_files, write_token_files
from gridweave.llm.tokens import Encoder, default_tokenizer, token_bytes

from .helpers import docs, odd_docs, words

LIBRARY = Tokenizer.from_file(default_tokenizer())
TEXTS = ["", None, "a", "one two  three\nfour ", "Ünïcode 日本語 text", "x " * 3000, " ".join(words(random.Random(2), 900)), "one two", "<|endoftext|> here", "z" * 9000]
IDS = [4, 9, 2, 7, 7, 30, 12, 1, 55, 50]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 60)
    own = Encoder(default_tokenizer())
    rng = random.Random(1)
    letters = [*"ab1 .,'\n\té\u2009\u3000日s're<|>  ", "<|endoftext|>"]
    for _ in range(400):
        batch = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4)] + [" ".join(words(rng, 20, 200))]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(batch)] == [ids_of(t) for t in batch]
    assert len(own.words) < 150


def test_added_token_strings_are_their_ids():
    own = Encoder(default_tokenizer())
    texts = ["<|endoftext|>", "a<|endoftext|>b", "hello <|endoftext|> world", "x y <|endoftext|>\n", "<|endoftext", None, "<|endoftext|><|endoftext|> z"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)] == [ids_of(t) for t in texts]
    assert 50256 in ids_of(texts[1])


def test_damaged_files(spark, tmp_path):
    manifest = write_token_files(docs(spark, TEXTS), f"file://{tmp_path}/t").collect()
    whole = Path(manifest[0].path.removeprefix("file://")).read_bytes()
    for raw in (whole[:20], whole[:-16], whole[:-3], whole[:14] + bytes([whole[14] ^ 1]) + whole[15:]):
        (tmp_path / "bad").write_bytes(raw)
        with pytest.raises(ValueError):
            list(read_file(f"file://{tmp_path}/bad"))


def test_paths_without_a_scheme(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and qualified(spark, f"file://{tmp_path}") == f"file://{tmp_path}"


def test_token_bytes():
    sizes = token_bytes(default_tokenizer())
    for t in TEXTS:
        assert sizes[np.array(ids_of(t), np.int64)].sum() == len((t or "").encode())


def test_histogram_packing():
    rng = random.Random(4)
    for limit in (16, 1024):
        counts = {n: rng.randrange(1, 200) for n in rng.sample(range(1, limit + 1), 12)}
        patterns = pack_histogram(counts, limit)
        got = {}
        for times, lengths in patterns:
            assert times > 0 and sum(lengths) <= limit
            for n in lengths:
                got[n] = got.get(n, 0) + times
        assert got == counts
        for n, (first_rank, _, _) in slots(patterns).items():
            assert first_rank[0] == 0 and (np.diff(first_rank) > 0).all()


def test_shortest_pack_first():
    """Longest first, each into the pack with the most room, pack by pack."""
    assert sorted(pack_histogram({6: 1, 5: 1, 3: 1}, 10)) == [(1, (5, 3)), (1, (6,))]
    assert sorted(pack_histogram({6: 2, 5: 1, 3: 2, 1: 1}, 10)) == [(1, (5, 3)), (1, (6, 1)), (1, (6, 3))]
    rng = random.Random(9)
    for _ in range(50):
        counts = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 33), 9)}
        packs = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                best = min(packs, key=sum, default=None)
                if best is None or sum(best) + n > 32:
                    packs.append([n])
                else:
                    best.append(n)
        got = pack_histogram(counts, 32)
        # Equally short packs are alike for what follows: only the sums count.
        assert sorted(sum(p) for p in packs) == sorted(sum(p) for times, p in got for _ in range(times))


def test_many_counts_are_joined_by_a_shuffle(spark, monkeypatch):
    held = docs(spark, TEXTS, IDS)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    one = pack(held, 64)
    monkeypatch.setattr(packing, "FEW_COUNTS", 0)
    other = pack(held, 64)
    assert "BroadcastHashJoin" in one._jdf.queryExecution().executedPlan().toString() and key(one) == key(other)


def test_pack(spark):
    limit = 64
    got = pack(odd_docs(spark, TEXTS, IDS), limit).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = sorted((i, len(ids_of(t)) + 1) for i, t in zip(IDS, TEXTS))
    assert sorted(pieces) == want
    for i, t in zip(IDS, TEXTS):
        ids = np.array([*ids_of(t), 0], "<u4")
        at = 0
        for r in sorted(pieces[i, len(ids)], key=lambda r: r.start):
            assert r.start == at and 0 < r.length <= limit
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= limit


def test_pack_fills_well(spark):
    rng = random.Random(9)
    got = pack(docs(spark, [" ".join(words(rng, rng.randrange(1, 400))) for _ in range(400)]), 1024).collect()
    used = sum(r.length for r in got)
    assert used / (1024 * len({r.sequence_id for r in got})) > 0.97


def test_pack_empty(spark):
    assert pack(docs(spark, [])).collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n).astype(np.int64)).astype(np.uint32)
        control, data = encode_block(x)
        assert len(control) == -(-n // 4) and (decode_block(n, control, data) == x).all()


def test_files_round_trip(spark, tmp_path):
    ids = [*IDS[:-1], None]
    manifest = write_token_files(odd_docs(spark, TEXTS, ids), f"file://{tmp_path}/out", file_ids=5000)
    got = read_token_files(manifest).collect()
    order = sorted(range(len(TEXTS)), key=lambda k: (ids[k] is not None, ids[k] or 0, len(ids_of(TEXTS[k])), zlib.crc32(np.array([*ids_of(TEXTS[k]), 0], "<u4").tobytes())))
    start, want = 0, []
    for k in order:
        own = np.array([*ids_of(TEXTS[k]), 0], "<u4")
        want.append((ids[k], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in got), key=key) == want
    files = sorted(str(p) for p in (tmp_path / "out").iterdir())
    assert [d for f in files for d, _ in read_file(f"file://{f}")] == [ids[k] for k in order]
    raw = bytearray(open(files[0], "rb").read())
    raw[-30] ^= 1
    open(files[0], "wb").write(raw)
    with pytest.raises(ValueError):
        list(read_file(f"file://{files[0]}"))


def test_files_empty(spark):
    assert read_token_files(write_token_files(docs(spark, []))).collect() == []


def brute_attribute(text, spans, rule):
    e = LIBRARY.encode(text, add_special_tokens=False)
    counts, at = [0] * len(spans), 0
    sizes = token_bytes(default_tokenizer())
    for i in e.ids:
        a, b = at, at + int(sizes[i])
        at = b
        shares = [max(0, min(b, t) - max(a, s)) for s, t in spans]
        if rule == "start":
            own = next((k for k, (s, t) in enumerate(spans) if s <= a < t), None)
        else:
            own = shares.index(max(shares)) if shares and max(shares) else None
        if own is not None:
            counts[own] += 1
    return counts


@pytest.mark.parametrize("rule", ["start", "most"])
def test_attribution(rule):
    rng = random.Random(6)
    sizes = token_bytes(default_tokenizer())
    for _ in range(60):
        text = "".join(rng.choice("abc d\n\né日 thing ") for _ in range(rng.randrange(120)))
        raw = text.encode()
        cuts = sorted(rng.sample(range(len(raw) + 1), min(4, len(raw))))
        spans = list(zip(cuts[::2], cuts[1::2]))
        got = attribute(np.array(ids_of(text), np.int64), sizes, np.array([s for s, _ in spans], np.int64), np.array([t for _, t in spans], np.int64), rule)
        assert got.tolist() == brute_attribute(text, spans, rule)


def test_line_counts(spark):
    got = {(r.doc_id, r.n_tokens): r.section_tokens for r in line_token_counts(odd_docs(spark, TEXTS, IDS)).collect()}
    for i, t in zip(IDS, TEXTS):
        own = got[i, len(ids_of(t))]
        starts, ends = line_spans((t or "").encode())
        assert own == brute_attribute(t or "", list(zip(starts.tolist(), ends.tolist())), "start")
        assert sum(own) == len(ids_of(t))


def test_field_counts(spark):
    rows = [(1, "Títle here. And a body.", [("title", 0, 11), ("body", 11, 23)]), (2, None, [("a", 0, 3)]), (3, "x", None), (4, "abc", [("all", 0, 99), ("none", None, 2)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, fields array<struct<name:string,start:long,end:long>>")
    got = {(r.doc_id, r.name): r.n_tokens for r in field_token_counts(df).collect()}
    assert got[1, "title"] + got[1, "body"] == len(ids_of(rows[0][1])) and got[2, "a"] == 0 and got[4, "all"] == 1 and (4, "none") not in got


def test_counts_of_an_empty_table(spark):
    assert line_token_counts(docs(spark, [])).collect() == []
