"""Versioned model store in a shared folder.

A version is a folder ``<root>/<name>/version=<n>`` with the model's files and a
manifest row (kind, parameters, features, checksum).  The checksum is a digest of the contents of the model's files,
read through Spark; loading computes it anew and refuses files that differ, so a
score can be pinned to a version and its checksum.  The manifest is written last:
a version without one (a writer that was lost) is not listed and its number is not taken again.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.ml.boosting import Booster, Params

MANIFEST = "name string, version int, kind string, params string, features array<string>, checksum string"
TREES = "round int, class int, node int, feature int, bin int, threshold double, value double, cover double"
#: Models of ``pyspark.ml`` by kind: they write and read themselves.
WRITERS = {"pipeline": PipelineModel, "logit": LogisticRegressionModel, "forest": RandomForestClassificationModel}


@dataclass(frozen=True)
class Saved:
    name: str
    version: int
    kind: str
    params: str
    features: list[str]
    checksum: str
    path: str


def _checksum(spark: SparkSession, path: str) -> str:
    """Digest over the digests of the model's data files, whatever their names (a bounded number of files)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    rows = files.select(F.regexp_extract("path", r"/model/(.*)/[^/]+$", 1).alias("part"), F.sha2("content", 256).alias("sha")).collect()
    return hashlib.sha256("\n".join(sorted(f"{r.part} {r.sha}" for r in rows)).encode()).hexdigest()


def _manifests(spark: SparkSession, root: str, name: str) -> list:
    try:
        found = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{root}/{name}/manifests")
        return sorted(found.collect(), key=lambda r: r.version)  # a row a version
    except AnalysisException:
        return []


def _tree_rows(spark: SparkSession, model: Booster) -> DataFrame:
    """One row a node; the number of nodes is bounded by rounds x classes x 2^(depth + 1)."""
    rows = []
    for r, k, n in zip(*(a.tolist() for a in np.nonzero(model.cover))):
        f, b = int(model.feature[r, k, n]), int(model.bin[r, k, n])
        edge = float(model.edges[f][b]) if f >= 0 and b < len(model.edges[f]) else None
        rows.append((r, k, n, f, b, edge, float(model.value[r, k, n]), float(model.cover[r, k, n])))
    return spark.createDataFrame(rows, TREES)


def save(spark: SparkSession, root: str, name: str, kind: str, model, params: dict | None = None, features: list[str] | None = None) -> Saved:
    """Write a fitted model as the next version of ``name``."""
    version = max((r.version for r in _manifests(spark, root, name)), default=0) + 1
    path = f"{root}/{name}/version={version}/model"
    if kind == "boosted":
        params, features = asdict(model.params), list(model.features)
        _tree_rows(spark, model).coalesce(1).sortWithinPartitions("round", "class", "node").write.mode("overwrite").parquet(f"{path}/trees")
        edges = [(j, c, [float(v) for v in e], next((g for g, x in enumerate(model.exclusive) if j in x), None)) for j, (c, e) in enumerate(zip(model.features, model.edges))]
        spark.createDataFrame(edges, "position int, feature string, edges array<double>, exclusive int").coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")
        params = {**params, "classes": model.classes, "rounds_grown": len(model.feature)}
    elif kind == "table":
        model.write.mode("overwrite").parquet(f"{path}/rows")
    else:
        model.write().overwrite().save(path)
    checksum = _checksum(spark, path)
    row = (name, version, kind, json.dumps(params or {}, sort_keys=True), features or [], checksum)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/{name}/manifests/v{version}")
    return Saved(*row, path)


def versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The manifest rows of a model, oldest first."""
    return spark.createDataFrame(_manifests(spark, root, name), MANIFEST)


def load(spark: SparkSession, root: str, name: str, version: int | None = None):
    """(model, its manifest) of a version, the latest by default; an error if its files are not those that were saved."""
    found = _manifests(spark, root, name)
    row = next((r for r in reversed(found) if version in (None, r.version)), None)
    if row is None:
        raise LookupError(f"no version {version or ''} of {name}")
    path = f"{root}/{name}/version={row.version}/model"
    if _checksum(spark, path) != row.checksum:
        raise ValueError(f"{name} version {row.version}: the files do not match the checksum")
    saved = Saved(*row, path)
    if row.kind == "boosted":
        return _booster(spark, saved), saved
    if row.kind == "table":
        return spark.read.parquet(f"{path}/rows"), saved
    return WRITERS[row.kind].load(path), saved


def _booster(spark: SparkSession, saved: Saved) -> Booster:
    params = json.loads(saved.params)
    classes, rounds = params.pop("classes"), params.pop("rounds_grown")
    edges = spark.read.parquet(f"{saved.path}/edges").orderBy("position").collect()
    groups: dict[int, list[int]] = {}
    for r in edges:
        if r.exclusive is not None:
            groups.setdefault(r.exclusive, []).append(r.position)
    model = Booster(list(saved.features), [np.array(r.edges, np.float64) for r in edges], Params(**params), classes, exclusive=[groups[g] for g in sorted(groups)])
    for _ in range(rounds):
        model.open_round()
    for r in spark.read.parquet(f"{saved.path}/trees").collect():
        at = (r["round"], r["class"], r["node"])
        model.feature[at], model.bin[at], model.value[at], model.cover[at] = r["feature"], r["bin"], r["value"], r["cover"]
    return model
