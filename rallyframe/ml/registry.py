"""Model bundles on shared storage: fitted parts, manifest, and checks before anything is loaded."""

from __future__ import annotations

import json
from dataclasses import asdict

import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rallyframe.ml.models import Calibrator, Fitted
from rallyframe.ml.preprocess import Preparation

_MODELS = {"logistic_regression": LogisticRegressionModel, "random_forest": RandomForestClassificationModel, "gradient_boosted_trees": GBTClassificationModel}
_CALIBRATORS = {"sigmoid": LogisticRegressionModel, "isotonic": IsotonicRegressionModel}


def _path(spark: SparkSession, name: str):
    """(file system, path) of any folder the session can reach, local or shared."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Checksum of every file below the bundle's parts, computed where the files lie."""
    found = {}
    for part in ("pipeline", "model", "calibrator"):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{part}")
        name = F.substring_index("path", f"/{part}/", -1)
        found |= {f"{part}/{r.name}": r.sha for r in rows.select(name.alias("name"), F.sha2("content", 256).alias("sha")).collect()}  # a bundle's files
    return dict(sorted(found.items()))


def write_bundle(folder: str, fitted: Fitted, calibrator: Calibrator, feature_version: str, split_id: str, metrics: dict) -> str:
    """Save once, to any folder the session can reach; an existing one is an error."""
    if calibrator.model is None:
        raise ValueError("the calibrator was fitted on no rows")
    spark = SparkSession.active()
    system, path = _path(spark, folder)
    if system.exists(path):
        raise FileExistsError(folder)
    fitted.pipeline.save(f"{folder}/pipeline")
    fitted.model.save(f"{folder}/model")
    calibrator.model.save(f"{folder}/calibrator")
    manifest = {
        "feature_version": feature_version, "split_id": split_id, "pyspark": pyspark.__version__, "metrics": metrics, "family": fitted.family,
        "calibrator": calibrator.kind, "preparation": asdict(fitted.prepare), "files": _files(spark, folder),
    }
    stream = system.create(_path(spark, f"{folder}/manifest.json")[1], False)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True, indent=1).encode()))
    stream.close()
    return folder


def load_bundle(folder: str, feature_version: str, split_id: str) -> tuple[Fitted, Calibrator, dict]:
    """Load only if versions and every checksum agree; else ValueError."""
    spark = SparkSession.active()
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json", wholetext=True).collect()))
    for key, want in (("feature_version", feature_version), ("split_id", split_id), ("pyspark", pyspark.__version__)):
        if manifest.get(key) != want:
            raise ValueError(f"{key}: bundle has {manifest.get(key)!r}, expected {want!r}")
    if manifest["family"] not in _MODELS or manifest["calibrator"] not in _CALIBRATORS:
        raise ValueError("unknown family or calibrator")
    if _files(spark, folder) != manifest["files"]:
        raise ValueError("a file of the bundle was changed, added or removed")
    prepare = Preparation(**manifest["preparation"])
    fitted = Fitted(manifest["family"], prepare, PipelineModel.load(f"{folder}/pipeline"), _MODELS[manifest["family"]].load(f"{folder}/model"))
    return fitted, Calibrator(manifest["calibrator"], _CALIBRATORS[manifest["calibrator"]].load(f"{folder}/calibrator")), manifest
