"""Extractor outputs: canonical records, raw responses, run logs, imported scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.sources.letters import read_whole_files
from goldmeter.sources.schemas import CANONICAL, RUN_LOG


def parse_canonical(files: DataFrame) -> DataFrame:
    """Add `record`; text that is not a JSON object gives a NULL record, never an error."""
    parsed = F.from_json("text", CANONICAL, {"mode": "PERMISSIVE"})
    is_object = F.get_json_object("text", "$").startswith("{")
    return files.withColumn("record", F.when(is_object, parsed))


def canonical_files(spark: SparkSession, root: str, layout: str, glob: str = "*canonical*.json") -> DataFrame:
    """Canonical records below a root; `layout` is a regex with named groups system, document, file.

    A layout without a system group leaves `system` empty for the caller to set.
    """
    files = read_whole_files(spark, root, glob, recursive=True)

    def group(name: str):
        order = [g for g in _group_names(layout)]
        if name not in order:
            return F.lit("")
        return F.regexp_extract("source_path", layout, order.index(name) + 1)

    found = files.select(
        group("system").alias("system"), group("document").alias("document_id"), group("file").alias("file"),
        "source_path", "text",
    )
    return parse_canonical(found)


def _group_names(layout: str) -> list[str]:
    import re

    return re.findall(r"\(\?<([a-z]+)>", layout)


def first_existing(candidates: DataFrame, preference: list[str]) -> DataFrame:
    """Per (system, document) the file that stands first in the preference list."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("file"))
    ranked = candidates.withColumn("_rank", rank).filter(F.col("_rank") > 0)
    rest = [c for c in candidates.columns if c not in ("system", "document_id")]
    return ranked.groupBy("system", "document_id").agg(
        F.min_by(F.struct(*rest), "_rank").alias("_pick")
    ).select("system", "document_id", "_pick.*")


def raw_responses(spark: SparkSession, root: str) -> DataFrame:
    """Every raw response below a root; ids come from the path unless the sibling projection names them."""
    raw = read_whole_files(spark, root, "raw_response.txt", recursive=True)
    sibling = parse_canonical(read_whole_files(spark, root, "canonical_projection.json", recursive=True))
    return describe_raw_responses(raw, sibling)


def describe_raw_responses(raw: DataFrame, projections: DataFrame) -> DataFrame:
    folder = F.regexp_extract("source_path", "^(.*)/[^/]+$", 1)
    parts = F.split(F.col("folder"), "/")
    named = projections.select(
        folder.alias("folder"), F.col("record.document_id").alias("p_doc"),
        F.col("record.metadata.harness_id").alias("p_harness"), F.col("record.metadata.model_label").alias("p_model"),
    )
    joined = raw.withColumn("folder", folder).join(named, "folder", "left")

    def level(i: int):
        return F.try_element_at(parts, F.lit(-i))

    def named_or(c: str, i: int):
        return F.coalesce(F.when(F.col(c) != "", F.col(c)), level(i), F.lit(""))

    return joined.select(
        "source_path", "text", named_or("p_doc", 1).alias("document_id"), named_or("p_harness", 2).alias("harness_id"),
        named_or("p_model", 3).alias("model_label"),
    )


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path)


def append_run_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def log_rows_of_condition(log: DataFrame, system: str) -> DataFrame:
    """Log rows that belong to a condition's system."""
    if system in ("S2", "S3"):
        return log.filter(F.col("baseline") == system)
    if system == "E2":
        return log.filter(F.col("pipeline").isin("E1", "E2"))
    return log.filter(F.col("pipeline") == system)


def union_runs(runs: dict[str, DataFrame], id_column: str = "run") -> DataFrame:
    """Stack runs with possibly different columns under a run id and ordinal."""
    tagged = [
        df.withColumn(id_column, F.lit(name)).withColumn(f"{id_column}_ord", F.lit(i))
        for i, (name, df) in enumerate(runs.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def import_scores(scores: DataFrame, system: str, condition: str) -> DataFrame:
    """Document scores of one named system under a new condition label."""
    return scores.filter(F.col("system") == system).withColumn("system", F.lit(condition)).withColumn(
        "condition", F.lit(condition)
    )
