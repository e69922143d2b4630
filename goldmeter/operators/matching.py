"""Set matching, precision/recall tables and class reports.

Sets are matched by one keyed aggregation over the stacked sides: copies of a key
collapse map-side, so neither a hot document nor a hot key is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_flags(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct union of two keyed sets with membership flags (a full outer match)."""
    stacked = predicted.select(*keys, F.lit(True).alias("in_pred"), F.lit(False).alias("in_gold")).unionByName(
        gold.select(*keys, F.lit(False).alias("in_pred"), F.lit(True).alias("in_gold"))
    )
    return stacked.groupBy(*keys).agg(F.max("in_pred").alias("in_pred"), F.max("in_gold").alias("in_gold"))


def count_flags(flags: DataFrame, by: list[str]) -> DataFrame:
    """True/false positives and false negatives per group."""
    p, g = F.col("in_pred"), F.col("in_gold")
    return flags.groupBy(*by).agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")
    )


def precision_of(tp: Column, fp: Column, fn: Column, empty_is_perfect: bool = True) -> Column:
    empty = F.when(fn == 0, 1.0).otherwise(0.0) if empty_is_perfect else F.lit(0.0)
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(empty)


def recall_of(tp: Column, fn: Column, empty_is_perfect: bool = True) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0 if empty_is_perfect else 0.0)


def f1_of(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, F.lit(2.0) * precision * recall / total).otherwise(0.0)


def with_rates(counts: DataFrame, empty_is_perfect: bool = True) -> DataFrame:
    """Add precision, recall and f1; the class and span reports use 0 for empty sides."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", precision_of(tp, fp, fn, empty_is_perfect)).withColumn(
        "recall", recall_of(tp, fn, empty_is_perfect)
    ).withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def micro_table(flags: DataFrame, by: list[str]) -> DataFrame:
    """Corpus precision/recall/F1 from summed counts (not a mean of document values)."""
    return with_rates(count_flags(flags, by))


def label_table(flags: DataFrame, by: list[str], label: str = "key") -> DataFrame:
    """Per-label rows plus one __micro__ row per group, in one pass over the label counts."""
    per_label = count_flags(flags, [*by, label])
    both = per_label.groupingSets(
        [[*[F.col(b) for b in by], F.col(label)], [F.col(b) for b in by]], *[F.col(b) for b in by], F.col(label)
    ).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping(label).alias("_all")
    )
    named = F.when(F.col("_all") == 1, "__micro__").otherwise(F.col(label))
    return with_rates(both.select(*by, named.alias("label"), "tp", "fp", "fn"))


def accuracy_rows(scores: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Document accuracy expressed as precision/recall rows labelled __document_accuracy__."""
    hit = F.col(correct)
    counts = scores.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    rate = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return counts.select(
        *by, F.lit("__document_accuracy__").alias("label"), "tp", "fp", F.lit(0).cast("long").alias("fn"),
        rate.alias("precision"), F.lit(1.0).alias("recall"), rate.alias("f1"),
    )


def accuracy_table(scores: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col(correct)).alias("correct"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
    )


def pair_counts(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """The confusion table; everything below works on it, never on documents."""
    return df.groupBy(*(by or []), F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_rows(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per-class tp/fp/fn/support/precision/recall/f1 over the union of both label sets."""
    by = by or []
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = pairs.select(
        *by, F.explode(F.array(
            F.struct(F.col("gold").alias("class"), F.col("n").alias("support"), hit.alias("tp"),
                     F.lit(0).cast("long").alias("called")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                     F.lit(0).cast("long").alias("tp"), F.col("n").alias("called")),
        )).alias("s"),
    ).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("called").alias("called"), F.sum("support").alias("support")
    )
    counts = sums.select(
        *by, "class", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"),
        "support",
    )
    return with_rates(counts, empty_is_perfect=False)


def class_report(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """micro (= accuracy), macro and weighted F1 with total support."""
    by = by or []
    rows = class_rows(pairs, by)
    return rows.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("micro_f1"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("support"),
    )


def expected_pairs(documents: DataFrame, systems: list[str], id_column: str = "document_id") -> DataFrame:
    """Every document under every system, generated row by row from the fixed list of systems."""
    return documents.select(F.explode(F.array(*[F.lit(s) for s in systems])).alias("system"), F.col(id_column))


def expected_available(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps absences as rows with available = false."""
    marked = found.withColumn("available", F.lit(True))
    return expected.join(marked, keys, "left").withColumn("available", F.coalesce("available", F.lit(False)))


def containment_match(predicted: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """Per key: does a predicted text contain, or lie in, any gold text?

    `predicted` has one row (key, value) per key; `gold` has (key, label) rows.
    """
    distinct_gold = gold.select(*key, "label").distinct()
    p, g = F.col("value"), F.col("label")
    hit = (p != "") & (p.contains(g) | g.contains(p))
    return predicted.join(distinct_gold, key, "left").groupBy(*predicted.columns).agg(
        F.coalesce(F.max(hit), F.lit(False)).alias("correct")
    )


def present_among(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` with a flag: does the key occur in `right`?"""
    marks = right.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return left.join(marks, keys, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")
