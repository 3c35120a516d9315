"""Sources and sinks: measurements, coil maps, result bundles and settings, as Parquet and JSON.

HDF5 and MAT files are read only where their libraries are installed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.operators.kspace import drop_unsampled, normalise_maps
from gridweave.schema import ReconConfig

KSPACE = "x INT, y INT, z INT, coil INT, t INT, re DOUBLE, im DOUBLE"
MAPS = "x INT, y INT, z INT, coil INT, re DOUBLE, im DOUBLE"
PARTS = ("recon", "components", "mask", "convergence", "metadata")


def read_kspace(spark: SparkSession, path: str) -> DataFrame:
    """Sampled measurements; exact zeros are dropped at ingest."""
    return drop_unsampled(spark.read.schema(KSPACE).parquet(path))


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Coil maps, normalised by voxel."""
    return normalise_maps(spark.read.schema(MAPS).parquet(path))


def result_name(base: str, scales: int) -> str:
    return f"{base}_{scales}scales"


def write_result(path: str, bundle: dict[str, DataFrame]) -> None:
    """One compressed table for each part of a result; components are partitioned by scale."""
    unknown = set(bundle) - set(PARTS)
    if unknown:
        raise ValueError(f"no such parts: {sorted(unknown)}")
    for name, table in bundle.items():
        writer = table.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("scale") if name == "components" else writer).parquet(f"{path}/{name}")


def read_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    out = {}
    for name in PARTS:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            out[name] = spark.read.parquet(f"{path}/{name}")
    if not out:
        raise FileNotFoundError(f"no result in {path}")
    return out


def write_config(spark: SparkSession, config: ReconConfig, path: str) -> None:
    spark.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> ReconConfig:
    return ReconConfig.from_json("\n".join(r.value for r in spark.read.text(path).collect()))


def _long(spark: SparkSession, array, names: tuple[str, ...]) -> DataFrame:
    """A complex array, dims in the order of names, as long rows of its nonzero cells."""
    import numpy as np
    import pandas as pd

    at = np.nonzero(array)
    columns = {n: (a + (n in ("coil", "t"))).astype("int32") for n, a in zip(names, at)}
    v = array[at]
    return spark.createDataFrame(pd.DataFrame({**columns, "re": v.real.astype(float), "im": v.imag.astype(float)}))


def read_hdf5_kspace(spark: SparkSession, path: str, dataset: str = "ksp_epi_zf") -> DataFrame:
    """A compound (real, imag) dataset of five dims. The file is read on the driver; convert large
    ones to Parquet first."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py; convert the file to Parquet") from e
    with h5py.File(path) as f:
        raw = f[dataset][...]
    return _long(spark, (raw["real"] + 1j * raw["imag"]).T, ("x", "y", "z", "coil", "t"))


def read_mat_maps(spark: SparkSession, path: str, key: str = "smaps") -> DataFrame:
    try:
        from scipy.io import loadmat
    except ImportError as e:
        raise ImportError("reading MAT files needs scipy; convert the file to Parquet") from e
    return normalise_maps(_long(spark, loadmat(path)[key], ("x", "y", "z", "coil")))
