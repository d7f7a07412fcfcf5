"""The lockfile: descriptions (and vectors) by uid and content hash, in one sorted JSON text that travels between
machines. It is as large as the described part of one project; it is read and written on the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..schema import FORMAT_VERSION, LOCK


def read(path: str) -> dict | None:
    """Entries by uid; None if there is no file, it is no JSON, or it has another version."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return None
    if not isinstance(data, dict) or data.get("version") != FORMAT_VERSION or not isinstance(data.get("structs"), dict):
        return None
    return data["structs"]


def as_frame(spark: SparkSession, entries: dict | None) -> DataFrame:
    rows = [(uid, e.get("diff_hash"), e.get("description"), e.get("vector")) for uid, e in sorted((entries or {}).items())]
    return spark.createDataFrame(rows, LOCK)


def write(path: str, described: DataFrame, with_vectors: bool = False) -> bool:
    """Writes ``uid, diff_hash, description[, vector]`` rows sorted by uid; False, and no write, if nothing changed."""
    entries = {}
    for r in described.orderBy("uid").toLocalIterator():
        entries[r["uid"]] = {"diff_hash": r["diff_hash"], "description": r["description"]} | ({"vector": list(r["vector"])} if with_vectors and r["vector"] is not None else {})
    text = json.dumps({"version": FORMAT_VERSION, "structs": entries}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    temp = f"{path}.{os.getpid()}.tmp"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)
    return True
