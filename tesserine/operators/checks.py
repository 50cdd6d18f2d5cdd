"""Contracts, gates, receipts: small driver-side rules around Spark frames."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.sources.tables import file_manifest

# Fixed list: suffixes that mark an ambiguous variant of an existing name.
FORBIDDEN_SUFFIXES = ("_enhanced", "_variant", "_adjusted", "_hybrid", "_corrected", "_composite")


class GateFailure(AssertionError):
    """A gate that must hold does not."""


def definition_hashes(registry: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The registry with a digest of each definition, which changes with any of the fields."""
    return registry.withColumn("definition_hash", F.sha2(F.to_json(F.struct(*sorted(fields))), 256))


def registry_problems(registry: DataFrame, fields: Sequence[str], names: Sequence[str], version: str) -> DataFrame:
    """(name, problem) of every rule a registry of (name, version, ...) rows breaks; no rows if it is sound."""
    blank = F.lit(False)
    for c in fields:
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    rules = {"blank field": blank, "ambiguous name": F.col("name").rlike("|".join(FORBIDDEN_SUFFIXES)), "not expected": ~F.col("name").isin(list(names)),
             "other version": F.col("version") != version}
    broken = registry.select("name", F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(rule)) for rule, hit in rules.items()]))).alias("problem"))
    counted = registry.groupBy("name").agg(F.count("*").alias("n"))
    expected = registry.sparkSession.createDataFrame([(n,) for n in names], "name string").join(counted, "name", "left")
    wrong = expected.where("n is null or n > 1").select("name", F.when(F.col("n").isNull(), "missing").otherwise("repeated").alias("problem"))
    return broken.unionByName(wrong)


def require_disjoint(groups: Mapping[str, Sequence[str]]) -> None:
    seen: dict[str, str] = {}
    for group, names in groups.items():
        for name in names:
            if name in seen:
                raise ValueError(f"{name!r} is in both {seen[name]!r} and {group!r}")
            seen[name] = group


def require_design(df: DataFrame, groups: Mapping[str, Sequence[str]], identifiers: Sequence[str]) -> DataFrame:
    """Every column is a registered feature or an identifier."""
    require_disjoint(groups)
    allowed = {c for names in groups.values() for c in names} | set(identifiers)
    stray = sorted(set(df.columns) - allowed)
    if stray:
        raise ValueError(f"columns outside the feature schema: {stray}")
    return df


def null_rate_gate(df: DataFrame, column: str, limit: float) -> DataFrame:
    rate = F.avg((F.col(column).isNull() | F.isnan(F.col(column).cast("double"))).cast("double"))
    return df.agg(rate.alias("null_rate"), (rate <= limit).alias("passes"))


def same_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows in one frame only, both ways (duplicates counted)."""
    a = first.exceptAll(second).agg(F.count("*").alias("only_first"), F.lit(1).alias("_k"))
    b = second.exceptAll(first).agg(F.count("*").alias("only_second"), F.lit(1).alias("_k"))
    return a.join(b, "_k").select("only_first", "only_second", ((F.col("only_first") == 0) & (F.col("only_second") == 0)).alias("passes"))


def require_gate(row: DataFrame, label: str) -> None:
    found = row.limit(1).collect()
    if not found or not found[0]["passes"]:
        raise GateFailure(f"{label}: {found}")


def largest_gap(first: DataFrame, second: DataFrame, key: str, column: str) -> DataFrame:
    """Largest absolute difference of one column over matching keys."""
    other = second.select(key, F.col(column).alias("_o"))
    return first.join(other, key).agg(F.count("*").alias("n"), F.max(F.abs(F.col(column) - F.col("_o"))).alias("gap"))


def identity(spark: SparkSession, path: str, glob: str = "*.parquet") -> str:
    """One digest for the names and contents of all files under a folder; at most 1,024 digests of file lists reach the driver."""
    line = F.concat_ws("=", "file", "sha256")
    lists = file_manifest(spark, path, glob).groupBy(F.pmod(F.xxhash64("file"), F.lit(1024)).alias("part")).agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("digest"))
    parts = {str(r["part"]): r["digest"] for r in lists.collect()}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, status) of files that are missing, added or changed between two manifests (file, sha256)."""
    a, b = found.select("file", F.col("sha256").alias("_a")), expected.select("file", F.col("sha256").alias("_b"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "added").otherwise("changed")
    return a.join(b, "file", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", status.alias("status"))


def verify_manifest(spark: SparkSession, path: str, expected: Mapping[str, str] | DataFrame, glob: str = "*.parquet") -> None:
    """Refuse a folder whose files differ from a manifest, given as a table (file, sha256) or a small mapping; ten files are named."""
    if isinstance(expected, Mapping):
        expected = spark.createDataFrame(list(expected.items()), "file string, sha256 string")
    changed = manifest_differences(file_manifest(spark, path, glob), expected).orderBy("file").limit(10).collect()
    if changed:
        raise GateFailure(f"files differ from the manifest: {[(r['file'], r['status']) for r in changed]}")


class OutputScope:
    """Outputs are confined to one folder."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        parts = PurePosixPath(name).parts
        if not parts or PurePosixPath(name).is_absolute() or any(p in (".", "..") for p in parts):
            raise ValueError(f"output name must stay inside the scope: {name!r}")
        return f"{self.root}/{name}"


class Receipts:
    """Stage records: input and output digests, refused on drift."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.scope = spark, OutputScope(root)
        self.records: dict[str, dict] = {}

    def verified(self, name: str) -> str:
        record = self.records.get(name)
        if not record or record["status"] != "completed":
            raise GateFailure(f"stage {name!r} is not completed")
        path = self.scope.path(name)
        if identity(self.spark, path) != record["output"]:
            raise GateFailure(f"outputs of stage {name!r} changed")
        return path

    def stage(self, name: str, inputs: Sequence[str], action: Callable[[str], None], depends: Sequence[str] = ()) -> dict:
        if name in self.records:
            raise GateFailure(f"stage {name!r} already ran")
        for dependency in depends:
            self.verified(dependency)
        before = {p: identity(self.spark, p) for p in inputs}
        began = time.monotonic()
        record = {"stage": name, "inputs": before, "depends": list(depends)}
        self.records[name] = record
        try:
            action(self.scope.path(name))
        except Exception as error:
            record.update(status="failed", message=str(error), seconds=time.monotonic() - began)
            raise
        drifted = [p for p, digest in before.items() if identity(self.spark, p) != digest]
        if drifted:
            record.update(status="failed", message=f"inputs changed: {drifted}")
            raise GateFailure(f"inputs changed during stage {name!r}: {drifted}")
        record.update(status="completed", output=identity(self.spark, self.scope.path(name)), seconds=time.monotonic() - began)
        return record
