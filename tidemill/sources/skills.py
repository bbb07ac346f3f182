"""Skill packages: zip files of a blob store, and what their SKILL.md says."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def package_path(skill_id: str, version: int) -> str:
    return f"{skill_id}/{version}/{skill_id}-{version}.zip"


def _stored(spark: SparkSession, root: str, skill_id: str, version: int):
    if not re.fullmatch(r"[\w-]+", skill_id) or version < 1:
        raise ValueError(f"not a package of the store: {skill_id!r} {version}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{package_path(skill_id, version)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_package(spark: SparkSession, root: str, skill_id: str, version: int, content: bytes) -> str:
    """Stores one package, over an older one of that version, in any file system that Spark reaches; gives its path."""
    files, path = _stored(spark, root, skill_id, version)
    out = files.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()


def delete_package(spark: SparkSession, root: str, skill_id: str, version: int) -> bool:
    """Whether there was such a package."""
    files, path = _stored(spark, root, skill_id, version)
    return files.delete(path, False)


def packages(spark: SparkSession, root: str) -> DataFrame:
    """(skill_id, version_number, path, length, content) of all packages in the store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root)
    where = F.regexp_extract("path", r"([^/]+)/(\d+)/[^/]+\.zip$", 1), F.regexp_extract("path", r"([^/]+)/(\d+)/[^/]+\.zip$", 2)
    return files.select(where[0].alias("skill_id"), where[1].try_cast("int").alias("version_number"), "path", "length", "content")


def front_matter(text: str) -> dict[str, str]:
    """The name: value lines between two --- lines at the start."""
    lines = text.lstrip("﻿").splitlines()
    if not lines or lines[0].strip() != "---":
        return {}
    out = {}
    for line in lines[1:]:
        if line.strip() == "---":
            return out
        name, colon, value = line.partition(":")
        if colon and name.strip() and not line[:1].isspace():
            out[name.strip()] = value.strip().strip("'\"")
    return {}


def describe(content: bytes) -> tuple[str | None, str | None, str | None]:
    """(name, description, text) of a package's first SKILL.md; all null if it has none or is no zip file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for entry in z.infolist():
                if entry.filename == "SKILL.md" or entry.filename.endswith("/SKILL.md"):
                    text = z.read(entry).decode("utf-8", "replace")
                    meta = front_matter(text)
                    return meta.get("name"), meta.get("description"), text
    except (zipfile.BadZipFile, OSError):
        pass
    return None, None, None


def described(packages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(skill_id, version_number, name, description, text): what packages say, else what the catalogue does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([describe(c) for c in pdf["content"]], columns=["name", "description", "text"], index=pdf.index)
            yield pd.concat([pdf[["skill_id", "version_number"]], found], axis=1)

    said = packages.select("skill_id", "version_number", "content").mapInPandas(run, "skill_id string, version_number int, name string, description string, text string")
    known = catalogue.select("skill_id", "version_number", F.col("name").alias("_name"), F.col("description").alias("_description"))
    return said.join(known, ["skill_id", "version_number"], "left").select("skill_id", "version_number", F.coalesce("name", "_name").alias("name"), F.coalesce("description", "_description").alias("description"), "text")
