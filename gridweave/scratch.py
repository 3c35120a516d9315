"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a local folder of our own, but only if driver and
    executors are one machine; a cluster without a shared folder is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="gridweave-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written one after another; drop() deletes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: list[tuple[str, str | None]] = []
        self.written = 0

    def keep(self, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """The table written and read back. ``by``: in buckets of those columns, as many as a shuffle has
        partitions, so that joins by them move the other side alone, or none that is bucketed likewise."""
        path = f"{self.root}/{self.written}"
        self.written += 1
        if not by:
            self.held.append((path, None))
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        name = f"gridweave_{uuid.uuid4().hex}"
        self.held.append((path, name))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # The first table is dealt to its buckets; later ones follow from joins that lie so already.
        dealt = df.repartition(buckets, *by) if self.written == 1 else df
        dealt.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *, but_last: int = 0) -> None:
        """Delete all tables but the last few."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = self.held[: len(self.held) - but_last]
        for path, name in gone:
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.held = self.held[len(gone) :]
