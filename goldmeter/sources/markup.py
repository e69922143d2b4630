"""Headerless ragged markup tables and the assembly of gold tables from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.functions import normalize as N
from goldmeter.functions.text import norm_value, slice_text, strip
from goldmeter.sources.letters import file_stem

# a field is quoted from its first character on, quotes doubled inside, or runs to the next comma or line end
_FIELD = r'(?:[ \t]*"[^"]*+(?:""[^"]*+)*+"[^,\n]*+|[^,\n]*+)'


def split_cells(row: Column) -> Column:
    """Cells of a row, as many as it has; quotes around a field go, doubled quotes inside become one."""
    def plain(c):
        body = F.regexp_extract(c, r'(?s)^[ \t]*"(.*)"[^"]*$', 1)
        return strip(F.when(c.rlike(r'(?s)^[ \t]*".*"'), F.replace(body, F.lit('""'), F.lit('"'))).otherwise(c))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), row), F.lit(f",({_FIELD})"), 1), plain)


def parse_markup_lines(lines: DataFrame) -> DataFrame:
    """(row_no, line) -> (row_no, cells): trimmed cells, as many as the row really has."""
    return lines.filter(F.col("line") != "").select(*[c for c in lines.columns if c != "line"], split_cells(F.col("line")).alias("cells"))


def split_rows(text: Column) -> Column:
    """Rows of a table's text; a line break inside a quoted field does not end its row."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(rf"\n({_FIELD}(?:,{_FIELD})*+)"), 1)


def markup_rows(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Rows(file_name, row_no, cells); a file that is not UTF-8 is read as Latin-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    lines = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.posexplode(split_rows(text)).alias("row_no", "line"))
    return parse_markup_lines(lines)


def _cell(i: int):
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


def _digits(c):
    return c.rlike("^[0-9]+$")


def _named(first: int, fallback: int):
    """Cell `first` unless it says null, else the fallback cell."""
    return F.when(F.lower(_cell(first)) == "null", _cell(fallback)).otherwise(_cell(first))


def _doc_rows(rows: DataFrame, minimum: int) -> DataFrame:
    return rows.filter(F.size("cells") >= minimum).withColumn("document_id", file_stem(_cell(0)))


def gold_medications(rows: DataFrame) -> DataFrame:
    return _doc_rows(rows, 10).select(
        "document_id", F.col("row_no").alias("ord"), N.medication_name(_named(4, 5)).alias("name"),
        N.dose_value(_cell(6)).alias("dose"), N.dose_unit(_cell(7)).alias("dose_unit"),
        N.dosing_schedule(_cell(8)).alias("frequency"),
    )


def gold_frequencies(rows: DataFrame, letters: DataFrame) -> DataFrame:
    """Count ranges "lo-hi", implied count 1 and implied period 1 included."""
    start, end = _cell(1), _cell(2)
    base = _doc_rows(rows, 11).join(letters.select("document_id", "text"), "document_id", "left")
    lower, upper, exact = norm_value(_cell(8)), norm_value(_cell(9)), norm_value(_cell(7))
    unit, n_units = N.singular_unit(_cell(10)), norm_value(_cell(11))
    first = F.when(exact != "", exact).when(lower != "", lower).otherwise(upper)
    count = F.when((lower != "") & (upper != ""), F.concat_ws("-", lower, upper)).otherwise(first)
    scope = F.filter(F.slice("cells", F.lit(13), F.greatest(F.size("cells"), F.lit(0))), lambda c: F.lower(c) != "null")
    surface = F.when(
        _digits(start) & _digits(end) & F.col("text").isNotNull(),
        slice_text(F.col("text"), start.try_cast("int"), end.try_cast("int")),
    )
    staged = base.select(
        "document_id", F.col("row_no").alias("ord"),
        F.when((count == "") & (unit != ""), "1").otherwise(count).alias("count"), unit.alias("period_unit"),
        n_units.alias("_n"), N.seizure_type(_named(5, 4)).alias("seizure_type"),
        norm_value(F.array_join(scope, " ")).alias("temporal_scope"), F.coalesce(surface, F.lit("")).alias("surface"),
    )
    rated = (F.col("count") != "") & (F.col("period_unit") != "")
    period = F.when(rated, F.when(F.col("_n") == "", "1").otherwise(F.col("_n"))).otherwise("")
    said = F.when(rated, F.concat_ws(" ", "count", F.lit("per"), "period_count", "period_unit")).otherwise(F.col("count"))
    return staged.withColumn("period_count", period).select(
        "document_id", "ord", norm_value(said).alias("value"), "count", "period_count", "period_unit", "seizure_type",
        "temporal_scope", "surface",
    )


def gold_types(frequencies: DataFrame) -> DataFrame:
    return frequencies.filter(F.col("seizure_type") != "").select(
        "document_id", "ord", F.col("seizure_type").alias("label")
    )


def _investigation_rows(rows: DataFrame) -> DataFrame:
    phrase = norm_value(_cell(4))
    result = F.when(phrase.contains("abnormal"), "abnormal").when(phrase.contains("normal"), "normal")
    kinds = F.array(*[F.when(phrase.contains(k), F.lit(k)) for k in ("eeg", "mri")])
    return _doc_rows(rows, 5).withColumn("result", result).filter(F.col("result").isNotNull()).withColumn(
        "kind", F.explode(F.filter(kinds, lambda k: k.isNotNull()))
    )


def gold_investigations(rows: DataFrame) -> DataFrame:
    """One row per document with the last stated EEG and MRI result."""
    hit = _investigation_rows(rows)
    return hit.groupBy("document_id").agg(*[
        F.max_by(F.when(F.col("kind") == k, F.col("result")), F.when(F.col("kind") == k, F.col("row_no"))).alias(k)
        for k in ("eeg", "mri")
    ])


def _affirmed_diagnoses(rows: DataFrame) -> DataFrame:
    return _doc_rows(rows, 9).filter((norm_value(_cell(7)) == "epilepsy") & (norm_value(_cell(6)) == "affirmed"))


def gold_diagnoses(rows: DataFrame) -> DataFrame:
    return _affirmed_diagnoses(rows).select(
        "document_id", F.col("row_no").alias("ord"), N.diagnosis(_named(5, 4)).alias("label")
    ).filter(F.col("label") != "")


def _spans(rows: DataFrame, group, label: str, value) -> DataFrame:
    return rows.filter(_digits(_cell(1)) & _digits(_cell(2))).select(
        "document_id", group.alias("group"), F.col("row_no").cast("long").alias("ord"), _cell(1).cast("int").alias("start"),
        _cell(2).cast("int").alias("end"), F.lit(label).alias("label"), value.alias("value"),
    )


def gold_spans(prescriptions: DataFrame, frequencies: DataFrame, investigations: DataFrame, diagnoses: DataFrame,
               annotations: DataFrame) -> DataFrame:
    inv_value = F.when(F.size("cells") > 5, _cell(5)).otherwise(_cell(4))
    parts = [
        _spans(_doc_rows(prescriptions, 10), F.lit("medications"), "Prescription", _cell(9)),
        _spans(_doc_rows(frequencies, 11), F.lit("seizure_frequency"), "SeizureFrequency", _cell(5)),
        _spans(_investigation_rows(investigations), F.col("kind"), "Investigations", inv_value),
        _spans(_affirmed_diagnoses(diagnoses), F.lit("diagnosis"), "Diagnosis", _cell(5)),
        annotations.select(
            "document_id", F.col("label").alias("group"), F.col("line_no").cast("long").alias("ord"),
            F.col("char_start").alias("start"), F.col("char_end").alias("end"), "label",
            F.col("annotation_text").alias("value"),
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def gold_tables(spark: SparkSession, markup_path: str, letters: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """The five gold tables and the gold spans."""
    rows = {f: markup_rows(spark, markup_path, f) for f in (
        "MarkupPrescriptions.csv", "MarkupSeizureFrequency.csv", "MarkupInvestigations.csv", "MarkupDiagnosis.csv")}
    pre, fre, inv, dia = rows.values()
    frequencies = gold_frequencies(fre, letters)
    return {
        "medications": gold_medications(pre),
        "frequencies": frequencies,
        "types": gold_types(frequencies),
        "investigations": gold_investigations(inv),
        "diagnoses": gold_diagnoses(dia),
        "spans": gold_spans(pre, fre, inv, dia, annotations),
    }
