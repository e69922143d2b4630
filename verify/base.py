"""Registry of driver queries and the small tools that keep Spark and SQL bindings in step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lit_sql(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def list_sql(values: list) -> str:
    return "[" + ", ".join(lit_sql(v) for v in values) + "]"


def pick(values: list, index: Column) -> Column:
    """values[index mod n] as a Spark expression."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values) + 1).cast("int"))


def pick_sql(values: list, index: str) -> str:
    return f"({list_sql(values)})[({index}) % {len(values)} + 1]"


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# whitespace trimmed by the library, for DuckDB's trim(text, characters)
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
NULL_WORDS_SQL = "('', 'null', 'none', 'nan', 'n/a', 'na', 'not stated', 'unknown')"


def norm_value_sql(x: str) -> str:
    inner = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9./]+', ' ', 'g'))"
    return f"(CASE WHEN {inner} IN {NULL_WORDS_SQL} THEN '' ELSE {inner} END)"


def norm_label_sql(x: str) -> str:
    return f"regexp_replace(replace(lower(trim(coalesce({x}, ''), {WS})), '-', ' '), '\\s+', ' ', 'g')"


def norm_text_sql(x: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({x}, ''), '‘’“”–—', '''''\"\"--'), '\\s+', ' ', 'g'), {WS})"


def contains_any_sql(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit_sql(t)})" for t in terms) + ")"


def map_sql(x: str, mapping: dict, default: str | None = None) -> str:
    cases = " ".join(f"WHEN {lit_sql(k)} THEN {lit_sql(v)}" for k, v in mapping.items())
    return f"(CASE {x} {cases} ELSE {default or x} END)"
