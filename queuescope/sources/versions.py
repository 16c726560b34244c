"""Parquet datasets whose parts are replaced as a whole, by committed versions.

A write puts its rows into a folder of its own and then commits a manifest: the list of all parts with the folder each one has
now. Readers take the newest manifest, so they see a write entirely or not at all. A part that a write stands for and
has no rows for is replaced by nothing. A write that fails before its commit leaves everything as it was. Two writers that
commit at once get different numbers; the later one adds its parts to what the other committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NULL = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a null key
_EMPTY = {"parts": [], "schemas": {}}


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def _text(spark: SparkSession, path: str) -> str:
    files, target = _files(spark, path)
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the newest committed manifest; number 0 if nothing was ever committed."""
    numbers = sorted((int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifests") if n.endswith(".json")), reverse=True)
    for number in numbers:
        try:
            return number, json.loads(_text(spark, f"{path}/manifests/{number:010d}.json"))
        except ValueError:  # still being written, or its writer was lost: not committed
            continue
    return 0, _EMPTY


def _commit(spark: SparkSession, path: str, parts: Mapping[tuple, str | None], schema: T.StructType) -> None:
    name = uuid.uuid5(uuid.NAMESPACE_OID, schema.json()).hex
    files_taken = {int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifests") if n.endswith(".json")}
    while True:
        number, old = manifest(spark, path)
        kept = [p for p in old["parts"] if tuple(p["key"]) not in parts]
        new = [{"key": list(k), "folder": f, "schema": name} for k, f in parts.items()]
        used = {p["schema"] for p in [*kept, *new]}
        schemas = {k: v for k, v in {**old["schemas"], name: schema.jsonValue()}.items() if k in used}
        number = max([number, *files_taken]) + 1
        files, target = _files(spark, f"{path}/manifests/{number:010d}.json")
        try:
            stream = files.create(target, False)  # refuses a number that is taken
        except Exception:
            if not files.exists(target):
                raise
            files_taken.add(number)
            continue
        try:
            stream.write(bytearray(json.dumps({"parts": kept + new, "schemas": schemas}).encode()))
        finally:
            stream.close()
        return


def write_parts(
    df: DataFrame, path: str, keys: Sequence[str], stands_for: Sequence[Sequence[str]] | None = None
) -> dict[tuple, str | None]:
    """Replace the parts of ``df``, one per value of ``keys``, in one job; returns (key values -> folder).

    ``stands_for`` lists further parts that this write replaces, with or without rows. Keys are also columns of the files, so
    every folder can be read by itself.
    """
    spark = df.sparkSession
    stage = f"{path}/versions/{uuid.uuid4().hex}"
    folders = {f"of_{k}": F.col(f"`{k}`").cast("string") for k in keys}
    df.withColumns(folders).write.partitionBy(*folders).parquet(stage)
    found: list[tuple[tuple, str]] = [((), "")]
    for _ in keys:
        found = [
            ((*key, None if value == _NULL else unquote(value)), f"{place}/{name}")
            for key, place in found
            for name in _names(spark, stage + place)
            if "=" in name
            for value in [name.split("=", 1)[1]]
        ]
    parts: dict[tuple, str | None] = {tuple(k): None for k in stands_for or ()}
    parts |= {key: stage[len(path) + 1 :] + place for key, place in found}
    _commit(spark, path, parts, df.schema)
    return parts


def read_parts(spark: SparkSession, path: str, wanted: Mapping[int, str] | None = None) -> DataFrame:
    """All current rows, or those of the parts whose key has the ``wanted`` values at their places; only their folders are read."""
    number, content = manifest(spark, path)
    if not number:
        raise FileNotFoundError(f"no dataset at {path}")
    parts = [p for p in content["parts"] if all(p["key"][i] == v for i, v in (wanted or {}).items())]
    fields: dict[str, T.StructField] = {}
    for name in dict.fromkeys(p["schema"] for p in parts or content["parts"]):
        for field in T.StructType.fromJson(content["schemas"][name]):
            known = fields.setdefault(field.name, T.StructField(field.name, field.dataType))
            if known.dataType != field.dataType:
                raise ValueError(f"column {field.name} is {known.dataType} in one part and {field.dataType} in another")
    schema = T.StructType(list(fields.values()))
    folders = [f"{path}/{p['folder']}" for p in parts if p["folder"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def remove_old(spark: SparkSession, path: str) -> int:
    """Delete versions and manifests that are no longer current, for a time when nobody reads them; returns how many versions."""
    number, content = manifest(spark, path)
    current = {p["folder"].split("/")[1] for p in content["parts"] if p["folder"]}
    gone = [n for n in _names(spark, f"{path}/versions") if n not in current]
    gone_manifests = [n for n in _names(spark, f"{path}/manifests") if n.endswith(".json") and int(n.removesuffix(".json")) < number]
    for old in [*(f"versions/{n}" for n in gone), *(f"manifests/{n}" for n in gone_manifests)]:
        files, target = _files(spark, f"{path}/{old}")
        files.delete(target, True)
    return len(gone)
