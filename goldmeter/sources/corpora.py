"""Perturbed corpora on storage: one folder per perturbation and version, and a manifest that is committed last.

A write puts its perturbations under a new version and then commits a manifest that names, for every perturbation of the corpus,
the version to read. Readers follow the newest complete manifest, so a write that fails leaves the corpus as it was, a rewrite
of one perturbation leaves the others' files untouched, and older manifests still read what they named. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("development", "validation", "test")


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Versions of the complete manifests."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    names = [x.getPath().getName() for x in store.listStatus(place)]
    return sorted(int(n) for n in names if store.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """perturbation_id, version, part, documents, characters of every perturbation; None before the first write."""
    known = _manifests(spark, path)
    if version is None:
        version = known[-1] if known else None
    return None if version is None else spark.read.parquet(f"{path}/manifest/{version}")


def write_corpus(corpus: DataFrame, path: str) -> int:
    """Write the perturbations that `corpus` holds (perturbation_id, document_id, text, ...) and return the new version.

    Perturbations of earlier writes that it doesn't hold stay. Rows with a null perturbation_id make no corpus: an error.
    """
    spark = corpus.sparkSession
    known = _manifests(spark, path)
    version = known[-1] + 1 if known else 0
    part = F.md5("perturbation_id")
    checked = F.coalesce(part, F.raise_error(F.lit("a row has no perturbation_id")).cast("string"))
    corpus.withColumn("_part", checked).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/data/{version}")
    facts = spark.read.parquet(f"{path}/data/{version}").groupBy("perturbation_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"))
    entries = facts.select("perturbation_id", F.lit(version).cast("long").alias("version"), part.alias("part"), "documents", "characters")
    before = manifest(spark, path)
    if before is not None:
        entries = entries.unionByName(before.join(entries.select("perturbation_id"), "perturbation_id", "left_anti"))
    entries.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")  # one row per perturbation
    return version


def read_corpus(spark: SparkSession, path: str, perturbations: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The corpus as the newest manifest, or that of `version`, names it; only the wanted perturbations' folders are read."""
    listed = manifest(spark, path, version)
    if listed is None:
        raise ValueError(f"no corpus has been committed at {path}")
    found = {r["perturbation_id"]: f"{path}/data/{r['version']}/_part={r['part']}" for r in listed.collect()}  # one row per perturbation
    missing = set(perturbations or []) - set(found)
    if missing:
        raise ValueError(f"the corpus lacks {', '.join(sorted(missing))}")
    return spark.read.parquet(*[p for i, p in sorted(found.items()) if perturbations is None or i in perturbations])


def corpus_splits(corpus: DataFrame) -> DataFrame:
    """split, document_id: generated documents stand in every split, so that each runner finds them."""
    return corpus.select(F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split"), "document_id")
