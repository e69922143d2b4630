"""Whole evaluation flow: records and gold tables to scores, support, abstention and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from goldmeter.operators import scoring as S


def evaluate(records: DataFrame, expected: DataFrame, gold: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All frames of one evaluation; each is lazy and shares its inputs with the others.

    `records`: system, document_id, record, text (available extractions only);
    `expected`: system, document_id (missing extractions stay visible).
    """
    facts = S.document_facts(records)
    flags = S.set_score_flags(records, gold)
    sets = S.set_scores(records, flags)
    scalars = S.scalar_scores(facts, gold)
    long_scalars = S.scalar_long(scalars)
    support = S.evidence_support(records, gold, scalars)
    abstentions = S.abstention(flags, records)
    return {
        "facts": facts, "flags": flags, "set_scores": sets, "scalars": scalars,
        "document_scores": S.document_scores(sets, long_scalars), "support": support, "abstention": abstentions,
        "summary": S.system_summary(expected, facts, sets, scalars, support, abstentions),
        "field_table": S.field_table(flags, long_scalars), "categories": S.category_reports(scalars),
    }
