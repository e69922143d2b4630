"""Sinks, dict-style readers and the artifact inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> None:
    """csv (with header), json, text or parquet sink; an empty frame gives an empty data set."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def read_csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; without a schema every column is a string."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def artifact_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("json", "jsonl", "csv"), suffix).otherwise("other")


def content_rows(content: Column, kind: Column) -> Column:
    """Rows of a csv (without header), jsonl or json text; NULL for other kinds."""
    lines = F.size(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""))
    as_array = F.json_array_length(content)
    as_object = F.size(F.json_object_keys(content))
    return (
        F.when(kind == "csv", F.greatest(lines - 1, F.lit(0))).when(kind == "jsonl", lines)
        .when(kind == "json", F.coalesce(as_array, as_object))
    ).cast("long")


def describe_contents(files: DataFrame) -> DataFrame:
    """(path, content binary) -> path, kind, size, sha256, row_count."""
    text = F.col("content").cast("string")
    kind = artifact_kind(F.col("path"))
    return files.select(
        "path", kind.alias("kind"), F.length("content").cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), content_rows(text, kind).alias("row_count"),
    )


def artifact_inventory(expected: DataFrame, described: DataFrame) -> DataFrame:
    """Every expected (id, path) with existence, size, hash and row count."""
    return expected.join(described, "path", "left").select(
        "id", "path", F.col("sha256").isNotNull().alias("exists"), artifact_kind(F.col("path")).alias("kind"),
        "size_bytes", "sha256", "row_count",
    )


def scan_artifacts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return describe_contents(files.select("path", "content"))
