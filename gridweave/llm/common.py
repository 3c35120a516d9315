"""What the operators of this subpackage share: safe column picking, the shared scratch
folder, and the text conventions that several of them use."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridweave.scratch import shared_folder

#: Deletes the characters that the dedup operators regard as white space.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def pick(df: DataFrame, *names: str, **casts: str) -> DataFrame:
    """Select exactly the named columns by position, so that extra columns, even ones that
    differ only in case or repeat a name, can never make a reference ambiguous.

    The first column of that exact name wins; without one, the first that matches when case
    is ignored. ``casts`` gives a type per name.
    """
    own = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*own)
    out = []
    for name in names:
        at = next((i for i, c in enumerate(df.columns) if c == name), None)
        if at is None:
            at = next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)
        if at is None:
            raise ValueError(f"no column {name!r} among {df.columns}")
        col = F.col(own[at])
        out.append((col.cast(casts[name]) if name in casts else col).alias(name))
    return plain.select(*out)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most about 4 MB, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


@contextlib.contextmanager
def fixed_size(spark: SparkSession) -> Iterator[None]:
    """For what runs meanwhile on a few numbers a row: the limit in bytes, for which Spark measures the batch at every row, is off."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def give_back() -> None:
    """Returns free memory to the system; idle Python workers otherwise hold what they once used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, giving memory back when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of a table of documents, whatever else it holds."""
    small_batches(df.sparkSession)
    return pick(df, "doc_id", "text", doc_id="long", text="string")


#: Scratch folders by scope, for release().
_held: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str, scope: str = "default") -> str:
    """A new, unused path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _held.setdefault(scope, []).append(path)
    return path


def stash(df: DataFrame, name: str, scope: str = "default", **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives the loss
    of any executor, and fixes values that a recomputation might change."""
    spark = df.sparkSession
    path = scratch_path(spark, name, scope)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: For stash: columns that hardly repeat a value need no dictionary.
PLAIN = {"parquet.enable.dictionary": "false"}


def release(spark: SparkSession, scope: str = "default") -> None:
    """Delete the scratch tables of a scope; only after the results that read them are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _held.pop(scope, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def lower_az(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def plain_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with columns named by position, and those names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def column_at(df: DataFrame, name: str) -> str:
    """The positional name (see plain_names) of a column."""
    if name in df.columns:
        return f"c{df.columns.index(name)}"
    low = [c.lower() for c in df.columns]
    if name.lower() in low:
        return f"c{low.index(name.lower())}"
    raise ValueError(f"no column {name!r} among {df.columns}")


def keep_where(df: DataFrame, udf, *columns: str) -> DataFrame:
    """The rows, with all columns, for which a boolean pandas UDF over some columns holds."""
    small_batches(df.sparkSession)
    plain, _ = plain_names(df)
    return plain.where(udf(*(F.col(column_at(df, c)) for c in columns))).toDF(*df.columns)


def group_bounds(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups of equal keys begin in a sorted table, and its end."""
    if not table.num_rows:
        return np.zeros(1, np.int64)
    new = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        x = table.column(k).to_numpy()
        new |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least_rows: int) -> Iterator[pa.Table]:
    """Joins the batches of a task that is sorted by ``keys`` (without nulls) into tables of
    about ``least_rows`` that end where a group ends."""
    rest: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        n += b.num_rows
        if n >= least_rows:
            table = pa.Table.from_batches(rest)
            cut = int(group_bounds(table, keys)[-2])
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).to_batches()
                n = table.num_rows - cut
    if rest:
        yield pa.Table.from_batches(rest)
