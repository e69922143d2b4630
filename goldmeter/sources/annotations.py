"""Stand-off annotation files, entity exports, relation and note lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.functions.text import norm_quote, slice_text, strip
from goldmeter.sources.letters import read_whole_files
from goldmeter.sources.schemas import ENTITY_EXPORT


def annotation_lines(files: DataFrame) -> DataFrame:
    """Lines(document_id, line_no, line) of annotation files given as (document_id, text)."""
    return files.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def text_bounds(lines: DataFrame, fragments: bool = True) -> DataFrame:
    """T lines; a fragmented span keeps its first start and last end, or is dropped."""
    cells = F.split("line", "\t", -1)
    meta = F.filter(F.split(cells[1], r"\s+"), lambda m: m != "")
    offsets = F.filter(
        F.split(F.array_join(F.slice(meta, 2, 1 << 20), " "), "[ ;]+"), lambda n: n.rlike(r"^[0-9]+$")
    )
    out = (
        lines.filter(F.col("line").startswith("T") & (F.size(F.split("line", "\t", -1)) >= 3))
        .withColumn("_meta", meta).withColumn("_off", offsets)
        .filter((F.size("_meta") >= 3) & (F.size("_off") >= 2))
    )
    if not fragments:
        out = out.filter(F.col("line").rlike(r"^T\d+\t\S+\s+\d+\s+\d+\t"))
    return out.select(
        "document_id", "line_no", cells[0].alias("ann_id"), F.col("_meta")[0].alias("label"),
        F.col("_off")[0].cast("int").alias("char_start"),
        F.element_at("_off", -1).cast("int").alias("char_end"), strip(cells[2]).alias("annotation_text"),
    )


def attribute_maps(lines: DataFrame) -> DataFrame:
    """One attribute map per (document, target); the last line of a name wins."""
    body = F.split("line", "\t", -1)[1]
    pattern = r"(?s)^\s*(\S+)\s+(\S+)(?:\s+(.*))?$"
    value = F.regexp_extract(body, pattern, 3)
    rows = lines.filter(
        F.col("line").startswith("A") & (F.size(F.split("line", "\t", -1)) >= 2) & body.rlike(pattern)
    ).select(
        "document_id", F.regexp_extract(body, pattern, 2).alias("ann_id"),
        F.struct(
            "line_no", F.regexp_extract(body, pattern, 1).alias("name"),
            F.when(value == "", "true").otherwise(value).alias("value"),
        ).alias("a"),
    )
    ordered = F.array_sort(F.collect_list("a"))
    names = F.array_distinct(F.transform("_a", lambda a: a["name"]))
    latest = F.transform(
        names, lambda n: F.element_at(F.filter(F.col("_a"), lambda a: a["name"] == n), -1)["value"]
    )
    return (
        rows.groupBy("document_id", "ann_id").agg(ordered.alias("_a"))
        .select("document_id", "ann_id", F.map_from_arrays(names, latest).alias("attributes"))
    )


def parse_annotations(files: DataFrame, fragments: bool = True) -> DataFrame:
    """Annotations with their attribute map, from (document_id, text) annotation files."""
    lines = annotation_lines(files)
    empty = F.create_map().cast("map<string,string>")
    return (
        text_bounds(lines, fragments)
        .join(attribute_maps(lines), ["document_id", "ann_id"], "left")
        .withColumn("attributes", F.coalesce("attributes", empty))
    )


def relation_and_note_lines(files: DataFrame) -> DataFrame:
    """R and N lines of annotation files as (document_id, line_no, kind, line)."""
    kind = F.substring("line", 1, 1)
    return annotation_lines(files).filter(kind.isin("R", "N")).select(
        "document_id", "line_no", F.when(kind == "R", "relation").otherwise("note").alias("kind"), "line"
    )


def locate_annotations(annotations: DataFrame, letters: DataFrame) -> DataFrame:
    """Add the source slice and the two location flags; letters may be missing."""
    joined = annotations.join(letters.select("document_id", "text"), "document_id", "left")
    cut = F.when(
        (F.col("char_start") < F.col("char_end")), slice_text(F.col("text"), F.col("char_start"), F.col("char_end"))
    ).otherwise(F.lit(""))
    said = norm_quote(F.col("annotation_text"))
    return joined.withColumn("source_text", F.when(F.col("text").isNotNull(), cut)).select(
        *annotations.columns, "source_text",
        (norm_quote(F.col("source_text")) == said).alias("match_by_offset"),
        F.contains(norm_quote(F.col("text")), said).alias("match_in_document"),
    )


def annotations(spark: SparkSession, path: str, letters: DataFrame | None = None, glob: str = "*.ann") -> DataFrame:
    parsed = parse_annotations(read_whole_files(spark, path, glob))
    return parsed if letters is None else locate_annotations(parsed, letters)


def parse_entity_exports(files: DataFrame) -> DataFrame:
    """Entity exports given as (document_id, text) with one JSON array per document."""
    array_schema = f"array<{ENTITY_EXPORT.simpleString()}>"
    return files.select(
        "document_id", F.posexplode(F.from_json("text", array_schema)).alias("ord", "e")
    ).select(
        "document_id", "ord", F.col("e.entity").alias("label"), F.col("e.start_index").cast("int").alias("char_start"),
        F.col("e.end_index").cast("int").alias("char_end"), F.col("e.text").alias("annotation_text"),
        F.col("e.attributes").alias("attributes"),
    )


def entity_exports(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return parse_entity_exports(read_whole_files(spark, path, glob))
