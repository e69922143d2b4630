"""Letter corpus, splits and frequency-label examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.functions.text import norm_label, norm_source, unix_lines
from goldmeter.sources.schemas import LABEL_EXAMPLE, SPLIT_FILE


def file_stem(path_col):
    return F.regexp_extract(path_col, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_whole_files(spark: SparkSession, path: str, glob: str, recursive: bool = False) -> DataFrame:
    """One row per file: path, stem and text with unified line ends."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    raw = reader.format("text").load(path)
    return raw.select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("source_path"),
        unix_lines(F.col("value")).alias("text"),
    ).withColumn("document_id", file_stem(F.col("source_path")))


def letters(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Letters(document_id, source_path, text, normalized_text)."""
    return read_whole_files(spark, path, glob).select(
        "document_id", "source_path", "text", norm_source(F.col("text")).alias("normalized_text")
    )


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """Splits(document_id, split, pos) of one split file."""
    doc = spark.read.schema(SPLIT_FILE).option("multiLine", True).json(path)
    names = [f.name for f in SPLIT_FILE.fields]
    stacked = doc.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])
    )).alias("split", "ids"))
    return stacked.select("split", F.posexplode("ids").alias("pos", "document_id"))


def split_ids(splits: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """Ids of one split in stored order; the limit is a prefix of the stored positions."""
    known = {f.name for f in SPLIT_FILE.fields}
    if split not in known:
        raise ValueError(f"unknown split: {split}")
    out = splits.filter(F.col("split") == split)
    return out if limit is None else out.filter(F.col("pos") < limit)


def label_example_rows(raw: DataFrame) -> DataFrame:
    """Flatten label records; records without a label are skipped."""
    block = F.col("`check__Seizure Frequency Number`")
    label = F.get(block["seizure_frequency_number"], F.lit(0))
    reference = block["reference"]
    return raw.filter(label.isNotNull()).select(
        F.concat(F.lit("GAN"), F.col("source_row_index")).alias("document_id"),
        "source_row_index",
        F.coalesce("clinic_date", F.lit("")).alias("text"),
        norm_label(label).alias("gold_label"),
        norm_label(F.coalesce(F.get(reference, F.lit(0)), F.lit(""))).alias("reference_label"),
        F.coalesce(F.get(reference, F.lit(1)), F.lit("")).alias("evidence_reference"),
        F.coalesce(block["analysis"], F.lit("")).alias("analysis"),
        F.coalesce("row_ok", F.lit(False)).alias("row_ok"),
    )


def label_examples(spark: SparkSession, path: str) -> DataFrame:
    return label_example_rows(spark.read.schema(LABEL_EXAMPLE).option("multiLine", True).json(path))
