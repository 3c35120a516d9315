"""The two pipelines, reconstruction and its analysis, and their command line."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.complexes import array_sum, magnitude, pair
from gridweave.functions.scalars import lipschitz, threshold_weight
from gridweave.operators import analysis, kspace as ks
from gridweave.operators.lowrank import nuclear_norm, patch_svst
from gridweave.operators.patches import Patches
from gridweave.operators.sense import SenseOp, pack, sense_combine, unpack
from gridweave.operators.solvers import power_iteration, solve
from gridweave.schema import ReconConfig
from gridweave.scratch import Scratch
from gridweave.sources import tables

log = logging.getLogger("gridweave")
KEYS = ("scale", "x", "y", "z")


def sum_scales(components: DataFrame) -> DataFrame:
    """Packed components (scale, x, y, z, re, im) to the packed image, their sum."""
    both = components.groupBy("x", "y", "z").agg(F.collect_list(F.struct("re", "im")).alias("a"))
    return both.select("x", "y", "z", array_sum(F.col("a.re")).alias("re"), array_sum(F.col("a.im")).alias("im"))


@dataclass
class Reconstruction:
    recon: DataFrame
    components: DataFrame
    mask: DataFrame
    convergence: DataFrame
    metadata: DataFrame

    def bundle(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in tables.PARTS}


@dataclass
class Prepared:
    """What a reconstruction starts from: scaled samples, the encoding operator, and the facts about both."""

    samples: DataFrame
    mask: DataFrame
    op: SenseOp
    weights: list[float]
    bound: float
    metadata: DataFrame


def prepare(kspace: DataFrame, maps: DataFrame, config: ReconConfig, *, voxels: int | None = None) -> Prepared:
    """Validates and scales the samples; the facts of a run (``metadata``) are known before it is solved."""
    spark = kspace.sparkSession
    scratch = Scratch(spark, "reconstruction")
    samples = ks.drop_unsampled(kspace)
    factor = ks.validate(samples, config.grid, config.coils, config.frames, voxels)
    # Written first: the quantile takes several passes over it.
    zero_filled = scratch.keep(sense_combine(samples, maps, config.grid, voxels))
    scale = ks.quantile_scale(zero_filled, magnitude(pair())).first().scale
    samples = ks.normalise(samples, scale)
    mask = ks.sampling_mask(samples)
    op = SenseOp(config.grid, mask, maps, voxels=voxels).keep_mask(scratch)
    sigma1 = config.sigma1
    if sigma1 is None:
        ones = pack(_all_cells(spark, config))
        sigma1 = power_iteration(None, lambda v: op.forward(unpack(v)), ones, apply_adjoint=lambda v: pack(op.adjoint(v)))[1]
    bound = lipschitz(config.scales, sigma1)
    weights = [threshold_weight(p, config.frames, config.grid) for p in config.patch_sizes]
    log.info("acceleration %.3f, scale %.6g, sigma1 %.6g, weights %s", factor, scale, sigma1, weights)
    facts = {"acceleration": factor, "sigma1": sigma1, "lipschitz": bound, "scale_factor": scale, "weights": weights, "config": json.loads(config.to_json())}
    metadata = spark.createDataFrame([(factor, sigma1, bound, scale, config.scales, config.iterations, json.dumps(facts))], "acceleration double, sigma1 double, lipschitz double, scale_factor double, n_scales int, iterations int, facts string")
    return Prepared(samples, mask, op, weights, bound, metadata)


def reconstruct(kspace: DataFrame, maps: DataFrame, config: ReconConfig, *, log_every: int = 1, voxels: int | None = None) -> Reconstruction:
    """Multi-scale low-rank reconstruction.

    Minimises half the squared residual of the encoded sum of scales plus each scale's weighted
    sum of patch nuclear norms. kspace: long samples; maps: normalised coil maps. Costs take a pass over all
    patches: they are logged every ``log_every`` iterations, and after the last one; 0: never. ``voxels``: how many of the grid's
    cells have a map, where that is not all.
    """
    spark = kspace.sparkSession
    ready = prepare(kspace, maps, config, voxels=voxels)
    samples, op, weights = ready.samples, ready.op, ready.weights
    shapes = [Patches(config.grid, p, s) for p, s in zip(config.patch_sizes, config.strides)]

    def of_scale(components: DataFrame, k: int) -> DataFrame:
        return components.where(F.col("scale") == k).select("x", "y", "z", "re", "im")

    def gradient(components: DataFrame) -> DataFrame:
        step = pack(op.gradient(unpack(sum_scales(components)), samples))
        return step.withColumn("scale", F.explode(F.sequence(F.lit(1), F.lit(config.scales)))).select(*KEYS, "re", "im")

    def prox(components: DataFrame, c: float) -> DataFrame:
        out = None
        for k, (w, shape) in enumerate(zip(weights, shapes), 1):
            own = patch_svst(of_scale(components, k), shape, c * w).withColumn("scale", F.lit(k)).select(*KEYS, "re", "im")
            out = own if out is None else out.unionByName(own)
        return out

    def costs(components: DataFrame) -> tuple[float, float]:
        dc = op.cost(unpack(sum_scales(components)), samples)
        return dc, sum(w * nuclear_norm(of_scale(components, k), s).first().nn for k, (w, s) in enumerate(zip(weights, shapes), 1))

    first = pack(op.adjoint(samples)).withColumn("scale", F.explode(F.sequence(F.lit(1), F.lit(config.scales))))
    start = first.select(*KEYS, *(F.when(F.col("scale") == 1, F.col(p)).otherwise(F.transform(p, lambda v: F.lit(0.0))).alias(p) for p in ("re", "im")))
    entries: list[tuple[int, float, float, bool]] = []

    def note(k: int, x: DataFrame, y: DataFrame, again: bool) -> None:
        if k % log_every and k != config.iterations:
            return
        entries.append((k, *costs(x), again))
        log.info("iteration %d: data %.6g, regulariser %.6g%s", *entries[-1][:3], ", restart" if again else "")

    found = solve(start, gradient, ready.bound, keys=KEYS, prox=prox, cost=lambda v: sum(costs(v)), mode=config.mode, restart=config.restart, iterations=config.iterations, parity_alias=config.parity_alias, fun=note if log_every else None)
    return Reconstruction(unpack(sum_scales(found.x)), unpack(found.x, KEYS), ready.mask, analysis.convergence(spark, entries), ready.metadata)


def _all_cells(spark: SparkSession, config: ReconConfig) -> DataFrame:
    nx, ny, nz = config.grid
    cells = spark.range(nx * ny * nz).select((F.col("id") % nx).cast("int").alias("x"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("z"))
    return cells.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(config.frames)))).withColumns({"re": F.lit(1.0), "im": F.lit(0.0)})


@dataclass
class Analysis:
    tsnr: DataFrame
    summary: DataFrame
    convergence: DataFrame | None
    components: DataFrame | None


def analyse(result: dict[str, DataFrame], *, detrended: bool = True, show_components: bool = False) -> Analysis:
    """Drift removal (of the summed image only), signal-to-noise map and its summary."""
    image = result["recon"]
    image = analysis.detrend(image) if detrended else image
    found = analysis.tsnr(image, magnitude(pair()))
    shown = analysis.first_frames(result["components"]) if show_components and "components" in result else None
    return Analysis(found, analysis.tsnr_summary(found), result.get("convergence"), shown)


def main(argv: list[str] | None = None) -> Analysis:
    parser = argparse.ArgumentParser(description="Analyse a result bundle.")
    parser.add_argument("path")
    parser.add_argument("--no-detrend", action="store_true")
    parser.add_argument("--show-components", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    found = analyse(tables.read_result(spark, args.path), detrended=not args.no_detrend, show_components=args.show_components)
    row = found.summary.first()
    print(f"mean tSNR {row.mean_tsnr:.2f}, largest {row.max_tsnr:.2f}")
    if found.convergence is not None:
        found.convergence.orderBy("iter").show()
    if found.components is not None:
        found.components.orderBy("scale", "x", "y", "z").show()
    return found


__all__ = ["Analysis", "Reconstruction", "Prepared", "analyse", "main", "prepare", "reconstruct", "sum_scales"]

if __name__ == "__main__":
    main()
