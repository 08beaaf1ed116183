"""Versioned model state: frames and pipelines below one root, published by one atomic step.

A version is written into a folder of its own. Only when all of it is there does a
numbered pointer file appear, by a rename that fails if another writer has taken the
number. Readers follow the highest pointer, so that a half-written version, or one whose
writer died, is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class State:
    """One published version: stored frames, pipelines and plain values by name."""

    version: int
    frames: Mapping[str, DataFrame]
    pipelines: Mapping[str, PipelineModel]
    values: Mapping[str, object] = field(default_factory=dict)


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    make, files = _files(spark, path)
    out = files.create(make(path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, ascending; an absent root has none."""
    path, files = _files(spark, root)
    folder = path(f"{root}/pointers")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def write_version(
    spark: SparkSession,
    root: str,
    frames: Mapping[str, DataFrame],
    pipelines: Mapping[str, PipelineModel] | None = None,
    values: Mapping[str, object] | None = None,
) -> str:
    """Write all parts of a version; returns its folder, which nobody reads before ``publish``."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/frames/{name}")
    for name, pipeline in (pipelines or {}).items():
        pipeline.write().save(f"{folder}/pipelines/{name}")
    schemas = {name: frame.schema.json() for name, frame in frames.items()}
    _write_text(spark, f"{folder}/contents.json", json.dumps({"frames": schemas, "pipelines": sorted(pipelines or {}), "values": dict(values or {})}))
    return folder


def publish(spark: SparkSession, root: str, folder: str, tries: int = 20) -> int:
    """Make a written version the current one; returns its number. Writers that meet take later numbers."""
    path, files = _files(spark, root)
    files.mkdirs(path(f"{root}/pointers"))
    if not files.exists(path(f"{folder}/contents.json")):
        raise ValueError(f"{folder} is not a complete version")
    for _ in range(tries):
        number = max(versions(spark, root), default=0) + 1
        draft = f"{root}/drafts/{uuid.uuid4().hex}"
        _write_text(spark, draft, folder)
        target = path(f"{root}/pointers/{number:08d}")
        if not files.exists(target) and files.rename(path(draft), target):
            return number
    raise RuntimeError(f"no free version number below {root}")


def commit(spark: SparkSession, root: str, frames, pipelines=None, values=None) -> int:
    return publish(spark, root, write_version(spark, root, frames, pipelines, values))


def load(spark: SparkSession, root: str, version: int | None = None) -> State:
    """The current version, or an earlier one by its number."""
    found = versions(spark, root)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no version {version or ''} below {root}")
    number = found[-1] if version is None else version
    folder = _read_text(spark, f"{root}/pointers/{number:08d}").strip()
    contents = json.loads(_read_text(spark, f"{folder}/contents.json"))
    from pyspark.sql.types import StructType

    frames = {
        name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{folder}/frames/{name}")
        for name, schema in contents["frames"].items()
    }
    pipelines = {name: PipelineModel.load(f"{folder}/pipelines/{name}") for name in contents["pipelines"]}
    return State(number, frames, pipelines, contents["values"])
