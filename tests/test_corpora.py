"""The corpus sink: rewrites, failed writes, older manifests, and folders that are not read."""

import pytest
from pyspark.sql import functions as F

from goldmeter.operators import perturb as X
from goldmeter.sources.corpora import corpus_splits, manifest, read_corpus, write_corpus


def test_versions(spark, tmp_path):
    path = str(tmp_path)
    letters = spark.createDataFrame([("d1", "One.\n"), ("d2", "Two."), ("d3", "")], "document_id string, text string")
    kinds = {p.id: p for p in X.LETTER_PERTURBATIONS}
    two = [kinds["planned_medication_trap"], kinds["family_history_trap"]]
    assert manifest(spark, path) is None
    with pytest.raises(ValueError):
        read_corpus(spark, path)
    assert write_corpus(X.perturb(letters, two), path) == 0
    first = sorted(map(tuple, read_corpus(spark, path).collect()))
    assert first == sorted(map(tuple, X.perturb(letters, two).collect())) and len(first) == 6
    changed = X.Perturbation("family_history_trap", X.PRESERVING, "exectv2", "new", X.append_note("New."))
    files = sorted(p for p in tmp_path.glob("data/0/**/*.parquet"))
    assert write_corpus(X.perturb(letters, [changed]), path) == 1
    now = read_corpus(spark, path)
    assert now.count() == 6 and now.filter("description = 'new'").count() == 3
    assert sorted(p for p in tmp_path.glob("data/0/**/*.parquet")) == files
    assert sorted(map(tuple, read_corpus(spark, path, version=0).collect())) == first
    assert {(r["perturbation_id"], r["version"], r["documents"]) for r in manifest(spark, path).collect()} == {("planned_medication_trap", 0, 3), ("family_history_trap", 1, 3)}
    bad = X.perturb(letters, two).withColumn("text", F.when(F.col("document_id").startswith("d2"), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        write_corpus(bad, path)
    assert sorted(map(tuple, read_corpus(spark, path).collect())) == sorted(map(tuple, now.collect()))
    only = read_corpus(spark, path, ["planned_medication_trap"])
    assert all("/data/0/" in f for f in only.inputFiles()) and only.count() == 3
    with pytest.raises(ValueError):
        read_corpus(spark, path, ["other"])
    assert {(r["split"], r["n"]) for r in corpus_splits(now).groupBy("split").agg(F.count_distinct("document_id").alias("n")).collect()} == {("development", 6), ("validation", 6), ("test", 6)}
