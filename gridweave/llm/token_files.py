"""Token ids in binary files: frequency-ranked ids, byte-aligned, with separate control bytes.

Ids are renamed by their rank of frequency over the whole corpus, so that frequent ids take one
byte. A rank is stored in one to four little-endian bytes; its number of bytes, less one, is two
bits of a control byte. Control bytes lie apart from the data bytes, four ids to each, so a
block is decoded by a table lookup on its control bytes and a gather.

A file holds a consecutive range of documents in ascending doc_id order:

    "GWIDS2\\0\\0", u32 number of ranks, u32 id of each rank, u32 CRC-32 of those ids,
    blocks: u32 documents, u32 ids, u32 data bytes, u32 CRC-32 of what follows in the block,
            u8 a document whether it has a doc_id, i64 doc_id a document, u32 ids a document,
            control bytes, data bytes
    a block of zero documents ends the file.

Order: ascending doc_id, null first; rows of equal doc_id by number and checksum of their ids.
Each document ends with an end id, so null and empty texts have exactly one id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, in_batches, least_partitions, scratch_path, stash
from .packing import END
from .tokens import default_tokenizer, encoder

MAGIC = b"GWIDS2\0\0"
BLOCK_IDS = 1 << 20
FILE_IDS = 32 << 20
#: Bytes of each of the four ids that a control byte describes.
_LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8)
    if len(ranks) and ranks.max() > 0xFFFF:
        size += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    end = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    start = end - size
    data[start] = ranks & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        data[start[more] + k] = ranks[more] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_block(n: int, control: bytes, data: bytes) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    flat = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = flat[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= flat[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _open(path: str):
    return pa.fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's own readers take it: one without a scheme lies in the default file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    full = place.getFileSystem(conf).makeQualified(place).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


class FileWriter:
    """Writes one file; the name appears only when it is whole, so a task can run again."""

    def __init__(self, path: str, id_of_rank: np.ndarray, attempt: str):
        self.fs, self.path = _open(path)
        self.part = f"{self.path}.{attempt}.part"
        self.out = self.fs.open_output_stream(self.part)
        table = id_of_rank.astype("<u4").tobytes()
        self.out.write(MAGIC + struct.pack("<I", len(id_of_rank)) + table + struct.pack("<I", zlib.crc32(table)))
        self.rank = np.zeros(int(id_of_rank.max(initial=0)) + 1, np.uint32)
        self.rank[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
        self.held: list[tuple[int | None, np.ndarray]] = []
        self.size = self.docs = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append((doc_id, ids))
        self.size += len(ids)
        if self.size >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        names = [d for d, _ in self.held]
        control, data = encode_block(self.rank[np.concatenate([x for _, x in self.held])])
        body = np.array([d is not None for d in names], np.uint8).tobytes() + np.array([d or 0 for d in names], "<i8").tobytes() + np.array([len(x) for _, x in self.held], "<u4").tobytes() + control + data
        self.out.write(struct.pack("<IIII", len(names), self.size, len(data), zlib.crc32(body)) + body)
        self.docs, self.ids = self.docs + len(names), self.ids + self.size
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        self.out.write(struct.pack("<IIII", 0, 0, 0, 0))
        self.out.close()
        self.fs.move(self.part, self.path)


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a file, block by block."""
    fs, place = _open(path)
    with fs.open_input_stream(place) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")

        def numbers(count: int) -> tuple[int, ...]:
            raw = f.read(4 * count)
            if len(raw) != 4 * count:
                raise ValueError(f"{path} is cut off")
            return struct.unpack(f"<{count}I", raw)

        (n,) = numbers(1)
        table = f.read(4 * n)
        if len(table) != 4 * n or numbers(1)[0] != zlib.crc32(table):
            raise ValueError(f"{path} is damaged")
        id_of_rank = np.frombuffer(table, "<u4")
        while True:
            docs, ids, size, crc = numbers(4)
            if not docs:
                return
            n_control = -(-ids // 4)
            body = f.read(13 * docs + n_control + size)
            if len(body) != 13 * docs + n_control + size or zlib.crc32(body) != crc:
                raise ValueError(f"{path} is damaged")
            known = np.frombuffer(body, np.uint8, docs)
            names = np.frombuffer(body, "<i8", docs, docs)
            lengths = np.frombuffer(body, "<u4", docs, 9 * docs)
            at = 13 * docs
            all_ids = id_of_rank[decode_block(ids, body[at : at + n_control], body[at + n_control :])]
            ends = np.cumsum(lengths.astype(np.int64))
            for k in range(docs):
                yield (int(names[k]) if known[k] else None), all_ids[ends[k] - lengths[k] : ends[k]]


def _encode(path: str):
    """Rows of documents (ids compressed) and, last of each task, one row of id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        press = zstandard.ZstdCompressor(level=1)
        seen = np.zeros(1, np.int64)
        names = ["doc_id", "counts", "ids", "n", "crc"]

        def batch(doc_ids, counts, ids, n, crc):
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.bool_()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=names)

        for b in batches:
            packed, n, crc = [], [], []
            got = [x + END for x in tok.encode_batch(b.column("text"))]
            if got:
                more = np.bincount(np.frombuffer(b"".join(got), "<u4"))
                if len(more) > len(seen):
                    seen = np.pad(seen, (0, len(more) - len(seen)))
                seen[: len(more)] += more
            for x in got:
                ids = np.frombuffer(x, "<u4")
                short = ids.max() <= 0xFFFF
                packed.append((b"2" if short else b"4") + press.compress(ids.astype("<u2").tobytes() if short else x))
                n.append(len(ids))
                crc.append(zlib.crc32(x))
            yield batch(b.column("doc_id").to_pylist(), [False] * len(n), packed, n, crc)
        if seen.any():
            yield batch([None], [True], [b"c" + press.compress(seen.astype("<i8").tobytes())], [0], [0])

    return run


def _unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed[1:])
    return np.frombuffer(raw, {50: "<u2", 52: "<u4", 99: "<i8"}[packed[0]])


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column("ids").to_pylist():
            n = _unpack(x)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["id", "n"])


def _write(folder: str, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, writer, path = context.partitionId(), None, ""
        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                if writer is None:
                    path = f"{folder}/ids-{shard:06d}.gwids"
                    writer = FileWriter(path, ranks.value, str(context.taskAttemptId()))
                writer.add(doc_id, _unpack(x))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([writer.docs], pa.int64()), pa.array([writer.ids], pa.int64())], names=["shard", "path", "docs", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, file_ids: int = FILE_IDS, scope: str = "default") -> DataFrame:
    """Encodes and writes all documents; returns the manifest: shard, path, docs, ids, and
    first, the number of ids in all files before. An empty table has an empty manifest."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "token-files", scope))
    rows = stash(documents(docs).transform(in_batches, _encode(tokenizer or default_tokenizer()), "doc_id long, counts boolean, ids binary, n long, crc long"), "token-rows", scope)
    counts = rows.where("counts").select("ids").transform(in_batches, _id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()  # one row per id of the vocabulary
    ranks = spark.sparkContext.broadcast(np.array([r.id for r in counts], np.uint32))
    files = max(least_partitions(spark), -(-sum(r.n for r in counts) // file_ids))
    fs, place = _open(folder)
    fs.create_dir(place, recursive=True)
    ordered = rows.where("not counts").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "n", "crc").select("doc_id", "ids")
    manifest = stash(ordered.transform(in_batches, _write(folder, ranks), "shard long, path string, docs long, ids long"), "token-manifest", scope)
    # One small row per file, as in a listing of the folder.
    return manifest.withColumn("first", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
            out = []
            for doc_id, ids in read_file(path):
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(out) >= 4096:
                    yield _spans(out)
                    out = []
            yield _spans(out)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 of each document."""
    n = least_partitions(manifest.sparkSession)
    return manifest.select("path", "first").repartition(n).transform(in_batches, _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
