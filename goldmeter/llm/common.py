"""Shared helpers: table access, folds, shared storage and Arrow batches."""

from __future__ import annotations

import importlib.util
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.session import ensure_checkpoint_dir

#: Folder of the public vocabularies where their package is not installed.
VOCABULARIES = "/opt/tokenizers"


def vocabulary(name: str, folder: str | None = None) -> str:
    """File of a public vocabulary: in `folder` if given, else in the installed package, else in VOCABULARIES."""
    found = None if folder else importlib.util.find_spec("public_tokenizers")
    return f"{folder or (found.submodule_search_locations[0] if found else VOCABULARIES)}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo `modulus`; a null id counts as remainder 1, so it is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(1))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as a URI. A folder without a scheme is one of the cluster's default storage."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in root and not root.startswith("file:"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
        root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: later plans start from files that outlive any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Partition count the session is sized for; used where tiny rows stand for heavy work and size-based coalescing would misjudge it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
