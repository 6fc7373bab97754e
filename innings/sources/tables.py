"""Stored tables, documents and small JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innings.sources import schemas


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, only_present: bool = True) -> None:
    """Overwrite; with partition columns and ``only_present`` just the partitions that ``df`` has are replaced.

    Rows are clustered by partition value first and adaptive execution splits
    large partitions, so a season neither turns into many small files nor
    into one task.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    mode = "dynamic" if partition_by and only_present else "static"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def project_known(df: DataFrame, allowed: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns a table accepts, and the names that were dropped."""
    keep = [c for c in df.columns if c in set(allowed)]
    return df.select(*keep), sorted(set(df.columns) - set(keep))


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.SCHEMAS[name]).parquet(path)


def replace_tables(root: str, matches: DataFrame, deliveries: DataFrame) -> dict[str, list[str]]:
    """Store both base tables anew, in their declared types; returns the dropped columns of each.

    Nothing of an earlier load stays, vanished seasons included.
    """
    dropped = {}
    for name, df in (("deliveries", deliveries), ("matches", matches)):
        known, dropped[name] = project_known(df, schemas.SCHEMAS[name].names)
        known = schemas.declared(known, schemas.SCHEMAS[name])
        by = ["season"] if name == "deliveries" and "season" in known.columns else None
        write_table(known, f"{root.rstrip('/')}/{name}", by, only_present=False)
    return dropped


# ---- versions: write a new one, then readers move to it ---------------------

def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match."""
    files, path = _file_system(spark, pattern)
    return [s.getPath().toString() for s in files.globStatus(path) or []]


def claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if it is there already, whoever made it."""
    files, path = _file_system(spark, path)
    return files.createNewFile(path)


def _versions(spark: SparkSession, root: str, marker: str = "v*/_SUCCESS") -> list[int]:
    return sorted(int(p.split("/")[-2][1:]) for p in listed(spark, f"{root.rstrip('/')}/{marker}"))


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The last finished version, or None when there is none yet."""
    done = _versions(spark, root)
    return spark.read.parquet(f"{root.rstrip('/')}/v{done[-1]:08d}") if done else None


def write_version(df: DataFrame, root: str) -> str:
    """A version is visible once its success marker exists, so a lost job leaves the old one in place.

    Its number is claimed by a file that only one writer can create, so two writers never share a folder.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    number = max([0, *_versions(spark, root, "v*/_SUCCESS"), *_versions(spark, root, "v*/_claimed")]) + 1
    while not claim(spark, f"{root}/v{number:08d}/_claimed"):
        number += 1
    path = f"{root}/v{number:08d}"
    df.write.mode("append").parquet(path)
    return path


# ---- JSON -------------------------------------------------------------------

def write_docs(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DOCUMENT).json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric records, absent values as zero or empty."""
    return spark.read.schema(schemas.METRICS).option("multiLine", True).json(path).fillna(0).fillna("")
