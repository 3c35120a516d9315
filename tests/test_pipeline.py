import numpy as np
import pytest

from gridweave.operators.kspace import normalise_maps
from gridweave.operators.sense import SenseOp
from gridweave.plans import pipeline
from gridweave.schema import ReconConfig
from gridweave.sources import tables
from gridweave.streaming.running import running_tsnr

GRID, FRAMES, COILS = (4, 4, 2), 6, 2


@pytest.fixture(scope="module")
def measured(spark):
    rng = np.random.default_rng(0)
    series = rng.normal(size=(32, 2)) @ rng.normal(size=(2, FRAMES)) + 0.01 * rng.normal(size=(32, FRAMES))
    cells = [(k % 4, k // 4 % 4, k // 16, t + 1, float(series[k, t]), 0.0) for k in range(32) for t in range(FRAMES)]
    image = spark.createDataFrame(cells, "x int, y int, z int, t int, re double, im double")
    maps = spark.createDataFrame([(x, y, z, c, 1.0 + 0.1 * c * x, 0.1 * y) for x in range(4) for y in range(4) for z in range(2) for c in (1, 2)], "x int, y int, z int, coil int, re double, im double")
    mask = image.where("(x + y + t) % 2 = 0").select("x", "y", "z", "t")
    unit = normalise_maps(maps)
    return image, SenseOp(GRID, mask, unit).forward(image), unit


def config(**more):
    return ReconConfig(GRID, FRAMES, COILS, (GRID, (2, 2, 2), (1, 1, 1)), (GRID, (1, 1, 1), (1, 1, 1)), **{"iterations": 3, **more})


def test_reconstruction_and_bundle(spark, measured, tmp_path):
    image, samples, maps = measured
    out = pipeline.reconstruct(samples, maps, config())
    log = out.convergence.orderBy("iter").collect()
    assert len(log) == 4 and log[-1].total < log[0].total
    facts = out.metadata.first()
    assert facts.acceleration == 2.0 and facts.n_scales == 3 and facts.lipschitz == 3.0
    assert out.recon.count() == 32 * FRAMES and out.components.count() == 3 * 32 * FRAMES
    place = f"file://{tmp_path}/{tables.result_name('run', 3)}"
    tables.write_result(place, out.bundle())
    tables.write_config(spark, config(), f"{place}/settings")
    back = tables.read_result(spark, place)
    assert set(back) == set(tables.PARTS) and tables.read_config(spark, f"{place}/settings") == config()
    found = pipeline.analyse(back, show_components=True)
    assert found.tsnr.count() == 32 and found.components.select("scale").distinct().count() == 3
    assert pipeline.main([place, "--no-detrend"]).summary.first().max_tsnr > 0
    with pytest.raises(FileNotFoundError):
        tables.read_result(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        tables.write_result(place, {"other": out.recon})


def test_unknown_sigma_is_estimated(measured):
    _, samples, maps = measured
    out = pipeline.reconstruct(samples, maps, config(sigma1=None, iterations=0))
    assert 0.9 < out.metadata.first().sigma1 <= 1.001


def test_sources(spark, measured, tmp_path):
    _, samples, maps = measured
    zero = samples.limit(1).selectExpr("x", "y", "z", "coil", "t", "0.0D re", "0.0D im")
    samples.unionByName(zero).write.parquet(f"{tmp_path}/k")
    maps.write.parquet(f"{tmp_path}/m")
    assert tables.read_kspace(spark, f"{tmp_path}/k").count() == samples.count()
    total = tables.read_maps(spark, f"{tmp_path}/m").selectExpr("sum(re * re + im * im) s").first().s
    assert total == pytest.approx(32, rel=1e-3)
    for read in (tables.read_hdf5_kspace, tables.read_mat_maps):
        with pytest.raises((ImportError, OSError)):
            read(spark, str(tmp_path / "none"))


def test_long_array(spark):
    a = np.zeros((2, 1, 1, 2, 3), complex)
    a[1, 0, 0, 0, 2] = 3 - 1j
    assert [tuple(r) for r in tables._long(spark, a, ("x", "y", "z", "coil", "t")).collect()] == [(1, 0, 0, 1, 3, 3.0, -1.0)]


def test_streaming(spark, measured, tmp_path):
    image, _, _ = measured
    image.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(image.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = running_tsnr(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("running").collect()
    assert len(rows) == 32 and all(r.frames == FRAMES for r in rows)
