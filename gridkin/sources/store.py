"""Saved models: Parquet tables and a metadata row, put in place in one step."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridkin.functions.targets import TargetSpec
from gridkin.operators.calibration import GeneticsModel
from gridkin.operators.models import DistanceModel

FORMAT = "gridkin-model-1"


class ArtifactError(ValueError):
    """A path that holds no model, or another one than was asked for."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _params(model: DistanceModel) -> list[tuple[str, str, list[int], float]]:
    out = []
    for name, value in model.params().items():
        out += [(type(model).__name__, name, [int(i) for i in at], float(v)) for at, v in np.ndenumerate(np.asarray(value, float))]
    return out


def save_model(spark: SparkSession, path: str, model: GeneticsModel) -> None:
    """Write params, calibrations and metadata beside path, then rename: path holds a whole model or what it held
    before. A model without parameters of its own (see DistanceModel.params) is refused."""
    new, old = f"{path}.new", f"{path}.old"
    meta = {
        "format": FORMAT, "kind": type(model.distance).__name__, "species": list(model.distance.species), "patch_size": model.distance.patch_size,
        "target": vars(model.target), "features": list(model.features), "head": model.head.name,
        "shapes": {k: list(np.shape(v)) for k, v in model.distance.params().items()},
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{new}/metadata")
    spark.createDataFrame(_params(model.distance), "model string, name string, idx array<int>, value double").write.mode("overwrite").parquet(f"{new}/params")
    if model.calibrations is not None:
        model.calibrations.write.mode("overwrite").parquet(f"{new}/calibrations")
    fs, target = _fs(spark, path)
    _, source = _fs(spark, new)
    _, aside = _fs(spark, old)
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise ArtifactError(f"{path} cannot be replaced")
    if not fs.rename(source, target):
        fs.rename(aside, target)
        raise ArtifactError(f"{path} cannot be written")
    fs.delete(aside, True)


def read_metadata(spark: SparkSession, path: str) -> dict:
    fs, at = _fs(spark, f"{path}/metadata")
    if not fs.exists(at):
        raise ArtifactError(f"{path} holds no model")
    try:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    except (ValueError, TypeError) as e:
        raise ArtifactError(f"{path}: the metadata cannot be read") from e
    if meta.get("format") != FORMAT:
        raise ArtifactError(f"{path}: unknown format {meta.get('format')!r}")
    return meta


def load_model(spark: SparkSession, path: str, template: DistanceModel) -> GeneticsModel:
    """The saved model in the shape of template, whose solver it keeps. Calibrations no longer count as converged."""
    meta = read_metadata(spark, path)
    if meta["kind"] != type(template).__name__:
        raise ArtifactError(f"{path} holds a {meta['kind']}, not a {type(template).__name__}")
    if len(meta["species"]) != len(template.species):
        raise ArtifactError(f"{path} has {len(meta['species'])} species, the template {len(template.species)}")
    want = {k: list(np.shape(v)) for k, v in template.params().items()}
    if meta["shapes"] != want:
        raise ArtifactError(f"{path} has parameters of the shapes {meta['shapes']}, the template {want}")
    arrays = {name: np.zeros(shape) for name, shape in meta["shapes"].items()}
    for r in spark.read.parquet(f"{path}/params").collect():  # the parameters of one model
        arrays[r.name][tuple(r.idx)] = r.value
    from dataclasses import replace

    model = replace(template.with_params(arrays), species=tuple(meta["species"]), patch_size=meta["patch_size"])
    calibrations: DataFrame | None = None
    if meta["head"] == "mlpe":
        calibrations = spark.read.parquet(f"{path}/calibrations")
        if "converged" in calibrations.columns:
            from pyspark.sql import functions as F

            calibrations = calibrations.withColumn("converged", F.lit(False)).withColumn("message", F.lit("loaded"))
    return GeneticsModel(model, TargetSpec(**meta["target"]), tuple(meta["features"]), calibrations)
