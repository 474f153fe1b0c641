"""Files and builds as tables: listings, JSON documents, snapshots by build, and what is still to do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fingerprint import fingerprint
from .shared import file_system


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, folder, name, length, modified) of all files under ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).drop("content")
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a fixed schema; unreadable ones are left out."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def write_documents(rows: DataFrame, path: str, *by: str) -> None:
    """One folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(*by).json(path)


def persist_snapshot(snapshot: DataFrame, path: str) -> None:
    """Append (build_id, artifact, fingerprint), a folder for each build."""
    snapshot.write.mode("append").partitionBy("build_id").parquet(path)


def load_snapshot(spark: SparkSession, path: str, build_id: str) -> DataFrame:
    """One build: only its folder is read."""
    return spark.read.parquet(path).where(F.col("build_id").cast("string") == build_id)


def previous_build(builds: DataFrame, build_id: str, valid: str = "valid") -> DataFrame:
    """The latest valid build whose id is strictly less, as text."""
    return builds.where((F.col("build_id") < build_id) & F.col(valid)).agg(F.max("build_id").alias("build_id"))


def still_to_do(inputs: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs.join(done.select(*key).distinct(), list(key), "left_anti")


def copied_right(source: DataFrame, target: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): whether a copy is there and has the same sha256."""
    s, t = (df.select(key, F.sha2(content, 256).alias(name)) for df, name in ((source, "a"), (target, "b")))
    return s.join(t, key, "left").select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "verified").otherwise("differs").alias("status"))


MANIFEST = "build_id string, table_name string, path string, n long, low decimal(38,0), high decimal(38,0), columns string"


def commit_build(root: str, build_id: str, tables: dict[str, DataFrame]) -> None:
    """Write a build's tables and then, as its only visible step, its manifest.

    Tables go to a staging folder of their own, are read again, counted and fingerprinted; the manifest, one file that is
    renamed into place, names them. A build whose writer fails has no manifest, so no reader sees any of its tables. A build
    that is committed again is replaced as a whole: of two manifests of a build the one written last counts.
    """
    spark = next(iter(tables.values())).sparkSession
    staged, rows = f"{root}/data/{uuid.uuid4().hex}", []
    for name, table in tables.items():
        path = f"{staged}/{name}"
        table.write.parquet(path)
        held = spark.read.schema(table.schema).parquet(path)
        f = fingerprint(held, [], held.columns).first()
        rows.append((build_id, name, path, f["n"], f["low"], f["high"], table.schema.json()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).withColumn("committed", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows of all builds that were committed, of each build the last ones; none where nothing was committed."""
    system, path = file_system(spark, f"{root}/manifest")
    schema = T.StructType.fromDDL(MANIFEST + ", committed timestamp")
    if not system.exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/manifest")
    last = rows.groupBy("build_id").agg(F.max("committed").alias("committed"))
    return rows.join(last, ["build_id", "committed"])


def load_build(spark: SparkSession, root: str, table: str, build_id: str | None = None) -> DataFrame:
    """A table of a committed build, of the greatest id if none is given."""
    rows = committed(spark, root).where(F.col("table_name") == table)
    row = (rows if build_id is None else rows.where(F.col("build_id") == build_id)).orderBy(F.desc("build_id")).first()
    if row is None:
        raise LookupError(f"no committed build has {table}")
    return spark.read.schema(T.StructType.fromJson(json.loads(row["columns"]))).parquet(row["path"])


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """(build_id, table_name) of committed tables whose rows are not those the manifest was written for."""
    out = []
    for row in committed(spark, root).collect():  # one row for each table of each build
        held = spark.read.schema(T.StructType.fromJson(json.loads(row["columns"]))).parquet(row["path"])
        f = fingerprint(held, [], held.columns).first()
        if (f["n"], f["low"], f["high"]) != (row["n"], row["low"], row["high"]):
            out.append((row["build_id"], row["table_name"]))
    return spark.createDataFrame(out, "build_id string, table_name string")


def remove_builds(spark: SparkSession, root: str, keep: int) -> None:
    """Remove all but the ``keep`` greatest committed builds, manifest first, then every staging folder that no manifest names."""
    rows = committed(spark, root).collect()
    stay = sorted({r["build_id"] for r in rows})[-keep:] if keep else []
    held = [tuple(r[c] for c in ("build_id", "table_name", "path", "n", "low", "high", "columns", "committed")) for r in rows if r["build_id"] in stay]
    system, old = file_system(spark, f"{root}/manifest")
    fresh = f"{root}/manifest-{uuid.uuid4().hex}"
    spark.createDataFrame(held, T.StructType.fromDDL(MANIFEST + ", committed timestamp")).coalesce(1).write.parquet(fresh)
    system.delete(old, True)
    system.rename(file_system(spark, fresh)[1], old)
    named = {r[2].rsplit("/", 2)[-2] for r in held}
    for status in system.listStatus(file_system(spark, f"{root}/data")[1]):
        if status.getPath().getName() not in named:
            system.delete(status.getPath(), True)
