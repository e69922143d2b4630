"""Statistics, decisions, costs, payload shaping, event selection and the run-log stream."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.operators import costs as CO
from goldmeter.operators import payloads as PL
from goldmeter.operators import perturb as X
from goldmeter.operators import quantiles as QU
from goldmeter.operators import records as R
from goldmeter.operators import review as RV
from goldmeter.operators import selection as SEL
from goldmeter.operators import statistics as ST
from goldmeter.streaming.latest import fold, read_latest, run_latest
from goldmeter.streaming.run_log import read_table, run_stream
from verify import clinic as C
from verify.base import WS, lit_sql, pick, pick_sql, query, table
from verify.corpus_queries import scratch

# ---- percentiles, resampling, tests -----------------------------------------------------


@query("latency_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return ST.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("sketched_percentiles", "SELECT event_type, p, count(*) AS n, true AS within_error FROM events, (VALUES (0.05), (0.5), (0.95)) v(p) GROUP BY 1, 2")
def sketched_percentiles(spark, d):
    """Whether the ranks of sketched percentiles lie within twice the stated error."""
    e = table(spark, d, "events")
    points = {"a": 0.05, "b": 0.5, "c": 0.95}
    found = ST.percentiles(e, ["event_type"], "value", points, exact=False)
    each = found.select("event_type", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(n).alias("q")) for n, p in points.items()])).alias("x")).select("event_type", "x.*")
    ranks = e.join(each, "event_type").groupBy("event_type", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("q")).alias("under"), F.count_if(F.col("value") <= F.col("q")).alias("upto"))
    error = 2 * QU.rank_error(2000)
    within = (F.col("under") / F.col("n") - error <= F.col("p")) & (F.col("p") <= F.col("upto") / F.col("n") + error)
    return ranks.select("event_type", "p", "n", within.alias("within_error"))


IT, SEED = 50, 42
H = "CAST('0x' || substr(md5('42:' || i || ':' || {0}), 1, 8) AS BIGINT)"
CUTS = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817, 4294967252, 4294967292, 4294967295]
POIS = "(CASE " + " ".join(f"WHEN h < {c} THEN {k}" for k, c in enumerate(CUTS)) + " ELSE 13 END)"


def label_stats(spark, d):
    return table(spark, d, "labels").select(F.lit("S").alias("system"), "doc_id", F.col("quality").cast("long").alias("tp"), F.col("toxic").cast("long").alias("fp"))


@query("poisson_bootstrap", f"""WITH b AS (SELECT i, doc_id, quality, toxic, {H.format('doc_id')} AS h FROM labels, range({IT}) r(i)), w AS (SELECT *, {POIS} AS w FROM b)
SELECT 'S' AS system, CAST(i AS INT) AS iteration, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * quality) AS BIGINT) AS tp, CAST(sum(w * toxic) AS BIGINT) AS fp FROM w WHERE w > 0 GROUP BY 2""")
def poisson_bootstrap(spark, d):
    return ST.bootstrap(label_stats(spark, d), ["system"], "doc_id", IT, SEED, ["tp", "fp"])


RES = f"""ps AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels), dr AS (SELECT i, {H.format('pos')} % n AS pick FROM ps, range({IT}) r(i)),
rs AS (SELECT i AS iteration, count(*) AS n, sum(quality) AS tp, sum(toxic) AS fp FROM dr JOIN ps ON ps.pos = dr.pick GROUP BY 1)"""


@query("exact_bootstrap", f"WITH {RES} SELECT 'S' AS system, CAST(iteration AS INT) AS iteration, n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM rs")
def exact_bootstrap(spark, d):
    return ST.resample_exact(label_stats(spark, d), ["system"], "doc_id", IT, SEED, ["tp", "fp"])


@query("bootstrap_interval", f"WITH {RES}, v AS (SELECT tp / n AS v FROM rs) SELECT 'S' AS system, count(*) AS iterations, round(stddev_pop(v), 9) AS standard_error, quantile_cont(v, 0.025) AS ci95_low, quantile_cont(v, 0.975) AS ci95_high FROM v")
def bootstrap_interval(spark, d):
    s = ST.resample_exact(label_stats(spark, d), ["system"], "doc_id", IT, SEED, ["tp", "fp"]).withColumn("v", F.col("tp") / F.col("n"))
    return ST.interval_table(s, ["system"], "v").withColumn("standard_error", F.round("standard_error", 9))


def utilities(spark, d):
    lab = table(spark, d, "labels")
    rows = lab.select("doc_id", F.inline(F.array(
        F.struct(F.lit("A").alias("system"), (F.col("doc_id") % 3 != 0).cast("double").alias("utility")),
        F.struct(F.lit("B").alias("system"), F.when(F.col("quality") == 1, (F.col("doc_id") % 4).cast("double") / 4).otherwise(0.5).alias("utility")))))
    return rows.withColumn("metric", F.lit("m"))


DIFF = "df AS (SELECT doc_id, CASE WHEN quality = 1 THEN (doc_id % 4) / 4 ELSE 0.5 END - CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS difference FROM labels)"


@query("sign_flip_test", f"""WITH {DIFF}, s AS (SELECT doc_id, CAST(round(difference * 1000000) AS BIGINT) AS dd FROM df), o AS (SELECT count(*) AS n, sum(dd) AS obs FROM s),
f AS (SELECT i, sum(CASE WHEN {H.format('doc_id')} % 2 = 0 THEN dd ELSE -dd END) AS t FROM s, range(200) r(i) GROUP BY 1), e AS (SELECT count(*) FILTER (abs(t) >= abs(obs)) AS extreme FROM f, o)
SELECT 'B' AS system, 'm' AS metric, n AS paired_documents, CAST(obs AS DOUBLE) / 1000000.0 / n AS observed_mean_delta, extreme, (extreme + 1) / 201.0::DOUBLE AS p_value FROM o, e""")
def sign_flip_test(spark, d):
    return ST.sign_flip_test(ST.paired_differences(utilities(spark, d), "A", ["doc_id"]), ["system", "metric"], "doc_id", 200, SEED)


# ---- composites, deltas, decisions ------------------------------------------------------

SUM = """sm AS (SELECT event_type AS system, avg(CAST(value > 20 AS INT)) AS m1, avg(CAST(value > 60 AS INT)) AS m2, CASE WHEN event_type <> 'view' THEN avg(CAST(user_id % 3 = 0 AS INT)) END AS m3, count(*) AS n_count FROM events GROUP BY 1)"""


def summaries(spark, d):
    def share(c):
        return F.avg(c.cast("double"))

    out = table(spark, d, "events").groupBy(F.col("event_type").alias("system")).agg(share(F.col("value") > 20).alias("m1"), share(F.col("value") > 60).alias("m2"), share(F.col("user_id") % 3 == 0).alias("m3"), F.count(F.lit(1)).alias("n_count"))
    return out.withColumn("m3", F.when(F.col("system") != "view", F.col("m3")))


@query("weighted_composite", f"WITH {SUM} SELECT system, (m1 * 0.5 + m2 * 0.3 + coalesce(m3, 0) * 0.2) / (0.8 + CASE WHEN m3 IS NULL THEN 0 ELSE 0.2 END) AS composite FROM sm")
def weighted_composite(spark, d):
    return ST.weighted_composite(summaries(spark, d), {"m1": 0.5, "m2": 0.3, "m3": 0.2})


@query("composite_inputs", f"""WITH {SUM} SELECT system, coalesce(nullif(CASE WHEN system = 'click' THEN 0 ELSE m1 END, 0), m2) AS epilepsy_diagnosis, CASE WHEN m3 IS NULL THEN m2 ELSE (m3 + m2) / 2 END AS investigation_score FROM sm""")
def composite_inputs(spark, d):
    s = summaries(spark, d).select("system", F.when(F.col("system") == "click", 0.0).otherwise(F.col("m1")).alias("epilepsy_diagnosis_accuracy_collapsed"), F.col("m2").alias("epilepsy_diagnosis_accuracy"), F.col("m3").alias("eeg_accuracy"), F.col("m2").alias("mri_accuracy"))
    return ST.with_composite_inputs(s).select("system", "epilepsy_diagnosis", "investigation_score")


@query("efficiency_adjusted", f"WITH {SUM} SELECT system, m1 / ln(n_count + 1) AS efficiency_adjusted FROM sm")
def efficiency_adjusted(spark, d):
    return ST.efficiency_adjusted(summaries(spark, d), "m1", "n_count").select("system", "efficiency_adjusted")


@query("benchmark_quality", f"WITH {SUM} SELECT system, (m1 + m2 + coalesce(m3, 0)) / (2 + CASE WHEN m3 IS NULL THEN 0 ELSE 1 END) AS benchmark_quality FROM sm")
def benchmark_quality(spark, d):
    return CO.benchmark_quality(summaries(spark, d), ["m1", "m2", "m3"])


LONG = f"{SUM}, lg AS (SELECT system, metric, value FROM (SELECT system, m1, m2, m3, CAST(n_count AS DOUBLE) AS n_count FROM sm) UNPIVOT INCLUDE NULLS (value FOR metric IN (m1, m2, m3, n_count)))"


def long_rows(spark, d):
    return ST.long_metrics(summaries(spark, d), ["system"], ["m1", "m2", "m3", "n_count"])


@query("metric_deltas", f"WITH {LONG} SELECT r.system, r.metric, r.value AS right_value, l.value AS left_value, r.value - l.value AS delta FROM lg r JOIN lg l ON l.metric = r.metric AND l.system = 'click' WHERE r.metric <> 'n_count'")
def metric_deltas(spark, d):
    lg = long_rows(spark, d)
    left = lg.filter("system = 'click'").drop("system")
    systems = ["view", "click", "error", "signup", "purchase"]
    # the baseline stands beside every system, so the comparison is an equi-join on (system, metric)
    base = left.withColumn("system", F.explode(F.array(*[F.lit(x) for x in systems])))
    return ST.metric_deltas(base, lg, ["system"]).select("system", "metric", "right_value", "left_value", "delta")


PERT = """rb AS (SELECT event_type AS system, 'p' || user_id % 6 AS perturbation_id, avg(CAST(value > 20 AS INT)) AS value FROM events GROUP BY 1, 2), cl AS (SELECT event_type AS system, avg(CAST(value > 20 AS INT)) AS clean_value FROM events GROUP BY 1), dl AS (SELECT *, value - clean_value AS delta FROM rb JOIN cl USING (system))"""


def robust_rows(spark, d):
    e = table(spark, d, "events")
    hit = F.avg((F.col("value") > 20).cast("double"))
    robust = e.groupBy(F.col("event_type").alias("system"), F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("perturbation_id")).agg(hit.alias("value")).withColumn("metric", F.lit("m1"))
    clean = e.groupBy(F.col("event_type").alias("system")).agg(hit.alias("value")).withColumn("metric", F.lit("m1"))
    return X.robust_deltas(robust, clean, ["system"])


@query("perturbed_metric_deltas", f"WITH {PERT} SELECT system, perturbation_id, value, clean_value, delta FROM dl")
def perturbed_metric_deltas(spark, d):
    return robust_rows(spark, d).select("system", "perturbation_id", "value", "clean_value", "delta")


NW = f"{PERT}, nw AS (SELECT c.system, count(*) AS comparison_count, count(*) FILTER (round(c.delta, 9) >= round(b.delta, 9)) AS no_worse_count FROM dl c JOIN dl b ON b.perturbation_id = c.perturbation_id AND b.system = 'click' WHERE c.system <> 'click' GROUP BY 1)"


def no_worse_rows(spark, d):
    return ST.no_worse(robust_rows(spark, d).withColumn("delta", F.round("delta", 9)), "click", ["perturbation_id", "metric"])


@query("no_worse_rate", f"WITH {NW} SELECT *, no_worse_count / comparison_count AS no_worse_rate FROM nw")
def no_worse_rate(spark, d):
    return no_worse_rows(spark, d)


@query("robustness_decision", f"WITH {NW} SELECT system, CASE WHEN no_worse_count / comparison_count > 0.5 AND system <> 'view' THEN 'pass_robustness_gate' ELSE 'continue_recovery_cycle' END AS decision FROM nw")
def robustness_decision(spark, d):
    nw = no_worse_rows(spark, d)
    gains = nw.select("system", F.lit(0.0).alias("mean_delta"))
    invalid = nw.select("system", F.when(F.col("system") == "view", 1).otherwise(0).alias("invalid_records"))
    return X.robustness_decision(nw, gains, invalid).select("system", "decision")


@query("wins_and_losses", f"WITH {PERT} SELECT system, count(*) FILTER (round(delta, 9) > 0) AS wins, count(*) FILTER (round(delta, 9) < 0) AS losses, CASE WHEN count(*) FILTER (round(delta, 9) > 0) > 0 AND count(*) FILTER (round(delta, 9) < 0) > 0 THEN 'conditional' WHEN count(*) FILTER (round(delta, 9) > 0) > 0 THEN 'recommended' WHEN count(*) FILTER (round(delta, 9) < 0) > 0 THEN 'not_recommended' ELSE 'neutral' END AS verdict FROM dl GROUP BY 1")
def wins_and_losses(spark, d):
    return ST.wins_and_losses(robust_rows(spark, d).withColumn("delta", F.round("delta", 9)), ["system"]).select("system", "wins", "losses", "verdict")


@query("degradation_summary", """SELECT event_type AS system, 'p' || user_id % 3 AS perturbation_id, count(*) AS documents, count(*) FILTER (event_id % 5 <> 0) AS available, count(*) FILTER (event_id % 5 <> 0 AND value > 30) / count(*) FILTER (event_id % 5 <> 0) AS schema_valid_rate,
 count(*) FILTER (event_id % 5 <> 0 AND event_id % 2 = 0) / count(*) FILTER (event_id % 5 <> 0) AS frequency_accuracy FROM events GROUP BY 1, 2""")
def degradation_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("system"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("perturbation_id"), (F.col("event_id") % 5 != 0).alias("available"), (F.col("value") > 30).alias("schema_valid"),
                                            F.lit(1.0).alias("quote_validity_rate"), F.when(F.col("event_id") % 2 == 0, "2-3 per Month").otherwise("x").alias("predicted"), F.lit("2 3 per month").alias("expected"))
    return X.degradation_summary(rows).drop("quote_validity_rate")


@query("trap_quotes", """SELECT 'p' || p_size % 4 AS perturbation_id, count(*) AS quotes, count(*) FILTER (p_partkey % 3 = 0) AS trap_quotes, count(*) FILTER (p_partkey % 5 = 0) AS invalid_quotes FROM part GROUP BY 1""")
def trap_quotes(spark, d):
    p = table(spark, d, "part")
    g = p.select(F.concat(F.lit("p"), (F.col("p_size") % 4).cast("string")).alias("perturbation_id"), F.col("p_partkey").alias("source_document_id"), F.col("p_name").alias("quote"), F.when(F.col("p_partkey") % 3 == 0, F.length("p_name") + 1).otherwise(F.length("p_name")).alias("char_end"), (F.col("p_partkey") % 5 != 0).alias("valid"))
    return X.trap_quotes(g, p.select(F.col("p_partkey").alias("document_id"), F.concat("p_name", F.lit(" \n ")).alias("text")), ["perturbation_id"])


# fixed values: the trap texts as literals of the oracle
TRAPS = [
    ("planned_medication_trap", "Planned change: If seizures worsen in future, we may consider adding levetiracetam 250 mg twice daily. No change is being made today."),
    ("negated_investigation_trap", "Investigation note: There is no report of an abnormal MRI in this letter."),
    ("gan_historical_frequency_trap", "Historical seizure frequency: Several years ago seizures were weekly, but this is not the current reporting interval."),
]


@query("trap_audit", f"""WITH {C.BASE}, tr(perturbation_id, note) AS (VALUES {", ".join(f"({lit_sql(a)}, {lit_sql(b)})" for a, b in TRAPS)}),
pt AS (SELECT bl.document_id, perturbation_id, length(rtrim(text, {WS})) AS edge, rtrim(text, {WS}) || chr(10) || chr(10) || note || chr(10) AS text, unnest(['abnormal MRI', 'weekly', 'levetiracetam', m1, 'nowhere said']) AS v FROM bl, tr),
f AS (SELECT *, instr(lower(text), lower(v)) AS at_ FROM pt)
SELECT perturbation_id, v AS value, count(*) FILTER (at_ > 0) AS quotes, count(*) FILTER (at_ > 0 AND at_ - 1 + length(v) > edge) AS trap_quotes, CAST(0 AS BIGINT) AS invalid_quotes FROM f GROUP BY 1, 2""")
def trap_audit(spark, d):
    b = C.base(spark, d)
    claims = b.select("document_id", F.explode(F.array(F.lit("abnormal MRI"), F.lit("weekly"), F.lit("levetiracetam"), F.col("m1"), F.lit("nowhere said"))).alias("value"))
    listed = [p for p in X.LETTER_PERTURBATIONS + X.LABEL_PERTURBATIONS if p.id in dict(TRAPS)]
    return X.trap_audit(b.select("document_id", "text"), claims, listed, ["perturbation_id", "value"])


@query("quality_cost_frontier", """SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""")
def quality_cost_frontier(spark, d):
    return ST.cost_frontier(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("eligible_frontier_rows", f"WITH {SUM} SELECT system FROM sm WHERE m1 >= 0.5 AND m2 >= 0.45 * m1")
def eligible_frontier_rows(spark, d):
    s = summaries(spark, d).select("system", F.lit("canonical_scored").alias("scoring_status"), F.lit("available").alias("availability_note"), F.col("m1").alias("call_success_rate"), F.lit(1.0).alias("parse_success_rate"), F.when(F.col("m2") >= F.lit(0.45) * F.col("m1"), 1.0).otherwise(0.0).alias("schema_valid_rate"))
    return ST.eligible_pairs(s, 0.5).select("system")


@query("target_decision", f"WITH {SUM} SELECT system, m1 >= 0.6 AND coalesce(m3, 0) >= 0.3 AS all_met, CAST(m1 >= 0.6 AS INT) + CAST(coalesce(m3, 0) >= 0.3 AS INT) AS met_targets, CASE WHEN m1 >= 0.6 AND coalesce(m3, 0) >= 0.3 THEN 'promote_to_robustness_gate' ELSE 'continue_recovery_cycle' END AS decision FROM sm")
def target_decision(spark, d):
    return ST.promotion(ST.target_status(summaries(spark, d), {"m1": 0.6, "m3": 0.3}))


@query("ranked_systems", f"WITH {SUM} SELECT system, m1 FROM sm ORDER BY coalesce(m3, 0) DESC, m1 DESC, system LIMIT 3")
def ranked_systems(spark, d):
    return ST.rank_systems(summaries(spark, d), ["m3", "m1"], 3).select("system", "m1")


@query("final_candidates", f"""WITH {SUM}, ok AS (SELECT * FROM sm WHERE m1 > 0), b AS (SELECT system FROM ok ORDER BY m1 DESC, system LIMIT 1), c AS (SELECT system FROM ok WHERE m3 IS NOT NULL ORDER BY m1 DESC, m3, system LIMIT 1)
SELECT system, string_agg(role, '|' ORDER BY role) AS roles FROM (SELECT system, 'best_quality' AS role FROM b UNION ALL SELECT system, 'best_cost_effective' FROM c) GROUP BY 1""")
def final_candidates(spark, d):
    s = summaries(spark, d).select("system", F.col("m1").alias("benchmark_quality"), F.lit(1.0).alias("schema_valid_rate"), F.lit(1.0).alias("quote_validity_rate"), F.col("m3").alias("mean_estimated_cost_usd"))
    return ST.final_candidates(s, "system")


@query("cheapest_system", f"WITH {SUM} SELECT system FROM sm ORDER BY m3 ASC NULLS LAST, system LIMIT 2")
def cheapest_system(spark, d):
    return ST.cheapest(summaries(spark, d), "m3", 2).select("system")


@query("metric_pivot", f"WITH {SUM} SELECT 'm3' AS metric, max(CASE system WHEN 'view' THEN m3 END) AS view, max(CASE system WHEN 'click' THEN m3 END) AS click, 'unavailable_metric' AS view_missing, CAST(NULL AS VARCHAR) AS click_missing FROM sm UNION ALL SELECT 'm1', max(CASE system WHEN 'view' THEN m1 END), max(CASE system WHEN 'click' THEN m1 END), NULL, NULL FROM sm")
def metric_pivot(spark, d):
    lg = long_rows(spark, d).filter(F.col("metric").isin("m1", "m3"))
    return RV.metric_pivot(lg, "metric", ["view", "click"])


@query("missing_metric_cells", "SELECT 'm3' AS metric, 'view' AS system, 'unavailable_metric' AS reason FROM events LIMIT 1")
def missing_metric_cells(spark, d):
    lg = long_rows(spark, d).filter(F.col("metric").isin("m1", "m3"))
    return RV.missing_cells(RV.metric_pivot(lg, "metric", ["view", "click"]), "metric", ["view", "click"])


@query("first_nonzero_value", "SELECT p_partkey, coalesce(nullif(p_size % 3, 0), nullif(p_size % 5, 0), p_size % 2)::DOUBLE AS v FROM part")
def first_nonzero_value(spark, d):
    return table(spark, d, "part").select("p_partkey", RV.first_nonzero(*[(F.col("p_size") % n).cast("double") for n in (3, 5, 2)]).alias("v"))


@query("run_comparison", """WITH r AS (SELECT user_id AS document_id, event_id AS o, value > 40 AS correct, event_type AS label FROM events), c AS (SELECT document_id, count(*) AS n, arg_min(correct, o) AS f, arg_max(correct, o) AS l, min(label) = max(label) AS same FROM r GROUP BY 1)
SELECT document_id, CASE WHEN n < 2 THEN '' WHEN NOT f AND l THEN 'fixed' WHEN f AND NOT l THEN 'regressed' WHEN f THEN 'both_correct' WHEN same THEN 'both_miss_same_prediction' ELSE 'both_miss' END AS delta FROM c""")
def run_comparison(spark, d):
    return RV.compare_runs(table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("run_ord"), (F.col("value") > 40).alias("correct"), F.col("event_type").alias("label")))


# ---- costs ------------------------------------------------------------------------------

PRICES = [("user", 2.0, 8.0), ("assistant", 0.5, 1.5), ("system", None, 1.0)]


def prices(spark):
    return spark.createDataFrame(PRICES, "model_label string, input_per_million double, output_per_million double")


CALLS = """cs AS (SELECT conv_id, turn, role AS model_label, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tin, turn * 10 AS tout, text FROM conversations), pr(model_label, pin, pout) AS (VALUES ('user', 2.0::DOUBLE, 8.0::DOUBLE), ('assistant', 0.5, 1.5), ('system', NULL, 1.0)),
co AS (SELECT cs.*, CASE WHEN pin IS NOT NULL THEN tin / 1000000.0::DOUBLE * pin + tout / 1000000.0::DOUBLE * pout END AS cost FROM cs JOIN pr USING (model_label))"""


def calls(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("model_label"), F.ceil(F.length("text") / 4).alias("input_tokens"), (F.col("turn") * 10).alias("output_tokens"), "text")
    return CO.call_costs(t, prices(spark))


@query("call_costs", f"WITH {CALLS} SELECT conv_id, turn, cost, CASE WHEN cost IS NULL THEN 'missing_price_or_usage' ELSE 'complete' END AS cost_status FROM co")
def call_costs(spark, d):
    return calls(spark, d).select("conv_id", "turn", "cost", "cost_status")


@query("combined_usage", f"WITH {CALLS} SELECT conv_id, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens, round(sum(cost), 12) AS cost, count(*) AS calls FROM co GROUP BY 1")
def combined_usage(spark, d):
    u = CO.combined_usage(calls(spark, d).withColumn("latency_ms", F.lit(1.0)), ["conv_id"])
    return u.select("conv_id", "input_tokens", "output_tokens", F.round("cost", 12).alias("cost"), "calls")


@query("cost_estimation_status", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'estimated_or_recorded' WHEN p_size % 4 = 0 THEN 'missing_registry_model_label' WHEN p_size % 3 = 0 THEN 'missing_token_usage' WHEN p_size % 2 = 0 THEN 'legacy_zero_token_usage' ELSE 'missing_registry_price' END AS status FROM part")
def cost_estimation_status(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", CO.cost_estimation_status(F.when(s % 5 == 0, 1.0), F.when(s % 4 != 0, "m"), F.when(s % 3 != 0, F.when(s % 2 == 0, 0).otherwise(5)), F.when(s % 2 == 0, 0).otherwise(5)).alias("status"))


@query("condition_plan", "SELECT p_partkey, p_size * 2 AS calls, p_size * 100 AS total_input_tokens, CASE WHEN p_partkey % 3 <> 2 THEN p_size * 100 / 1000000.0::DOUBLE * (CASE p_partkey % 3 WHEN 0 THEN 2.0 ELSE 0.5 END) + p_size * 10 / 1000000.0::DOUBLE * (CASE p_partkey % 3 WHEN 0 THEN 8.0 ELSE 1.5 END) END AS estimated_cost_usd FROM part")
def condition_plan(spark, d):
    plan = table(spark, d, "part").select("p_partkey", pick(["user", "assistant", "system"], F.col("p_partkey")).alias("model"), F.col("p_size").alias("documents"), F.lit(100).alias("input_tokens"), F.lit(10).alias("output_tokens"), F.lit(2).alias("calls_per_document"))
    return CO.condition_plan(plan, prices(spark)).select("p_partkey", "calls", "total_input_tokens", "estimated_cost_usd")


@query("factorial_size", "SELECT count(DISTINCT p_type) AS model_count, count(DISTINCT p_size) AS harness_count, count(DISTINCT p_type) * count(DISTINCT p_size) AS full_factorial_conditions FROM part")
def factorial_size(spark, d):
    p = table(spark, d, "part")
    return CO.factorial_size({"model": p.select("p_type"), "harness": p.select("p_size")})


LOG = "lt AS (SELECT user_id, event_type, arg_max(value > 20, event_id) AS ps, arg_max(value > 60, event_id) AS ra, arg_max(value > 90, event_id) AS rs FROM events GROUP BY 1, 2)"
HEALTH = f"{LOG}, ex AS (SELECT c_custkey % 400 AS user_id, unnest(['view', 'click']) AS event_type FROM customer), xd AS (SELECT DISTINCT * FROM ex), hj AS (SELECT xd.event_type AS system, ps, ra, rs, ps IS NOT NULL AS have FROM xd LEFT JOIN lt USING (user_id, event_type))"
HEALTH_SELECT = "SELECT system, count(*) AS documents_expected, count(*) FILTER (have) AS log_records_available, count(*) FILTER (ps) / count(*) AS parse_success_rate, count(*) FILTER (ra) / count(*) AS repair_attempt_rate, count(*) FILTER (rs) / count(*) FILTER (ra) AS repair_success_rate FROM hj GROUP BY 1"


def log_rows(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("system"), F.col("event_id").alias("log_order"), (v > 20).alias("parse_success"), (v > 60).alias("repair_attempted"), (v > 90).alias("repair_succeeded"))


def expected_log(spark, d):
    return table(spark, d, "customer").select((F.col("c_custkey") % 400).alias("document_id"), F.explode(F.array(F.lit("view"), F.lit("click"))).alias("system")).distinct()


@query("parse_health", f"WITH {HEALTH} {HEALTH_SELECT}")
def parse_health(spark, d):
    return CO.parse_health(expected_log(spark, d), log_rows(spark, d), ["document_id", "system"], "log_order", ["system"])


@query("streamed_parse_health", f"WITH {HEALTH} {HEALTH_SELECT}")
def streamed_parse_health(spark, d):
    """The same report from the table an incremental stream keeps: two log drops, processed one after the other."""
    root = scratch(spark)
    log = log_rows(spark, d)
    for part in (F.col("log_order") % 2 == 0, F.col("log_order") % 2 == 1):
        log.filter(part).write.mode("append").json(f"{root}/log")
        run_stream(spark, f"{root}/log", log.schema, f"{root}/table", f"{root}/state", ["document_id", "system"], "log_order")
    stored = read_table(spark, f"{root}/table").drop("slot", "version")
    return CO.parse_health(expected_log(spark, d), stored, ["document_id", "system"], "log_order", ["system"])


@query("streamed_latest_events", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def streamed_latest_events(spark, d):
    """Latest event per user and type from keyed stream state: three drops, the second one late, folded in between."""
    root, keys = scratch(spark), ["user_id", "event_type"]
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    for n, part in enumerate((2, 0, 1)):
        events.filter(F.pmod(F.floor(F.col("event_id") / 7), F.lit(3)) == part).write.mode("append").parquet(f"{root}/log")
        run_latest(spark.readStream.schema(events.schema).parquet(f"{root}/log"), f"{root}/table", f"{root}/state", keys, "event_id")
        if n == 1:
            fold(spark, f"{root}/table", keys)
    return read_latest(spark, f"{root}/table", keys).select("user_id", "event_type", "event_id", "value")


@query("call_summary", """WITH c AS (SELECT event_type AS model_label, CASE WHEN value > 200 THEN 'failed' ELSE 'success' END AS st, value, event_id FROM events)
SELECT model_label, count(*) AS documents, count(*) FILTER (st = 'success') AS successful_calls, count(*) FILTER (st = 'success') / count(*) AS call_success_rate, CASE WHEN count(*) FILTER (st = 'success') < count(*) THEN 'mostly_available_with_transient_503' ELSE 'available' END AS availability_note,
 count(*) FILTER (event_id % 3 = 0) / count(*) AS parse_success_rate, quantile_cont(value, 0.5) AS latency_p50_ms, quantile_cont(value, 0.95) AS latency_p95_ms FROM c GROUP BY 1""")
def call_summary(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("model_label"), F.when(F.col("value") > 200, "failed").otherwise("success").alias("status"), F.when(F.col("value") > 200, "HTTP 503").alias("error"), (F.col("event_id") % 3 == 0).alias("parse_success"),
                    F.lit(False).alias("repair_attempted"), F.lit(False).alias("repair_succeeded"), F.col("value").alias("latency_ms"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(0.1).alias("cost"))
    return CO.call_summary(rows, ["model_label"]).select("model_label", "documents", "successful_calls", "call_success_rate", "availability_note", "parse_success_rate", "latency_p50_ms", "latency_p95_ms")


@query("token_budget_alarms", """SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN 'stop_reason=Length; ' ELSE '' END || CASE WHEN length(text) >= 300 * 0.95 THEN 'output_tokens_near_max_output_tokens; ' ELSE '' END, '; ') AS reasons FROM conversations""")
def token_budget_alarms(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lit(300).alias("max_output_tokens"), F.length("text").alias("output_tokens"), F.lit(0).alias("reasoning_tokens"), F.when(F.col("turn") % 3 == 0, "Length").otherwise("stop").alias("stop_reason"))
    return CO.budget_alarms(c).select("conv_id", "turn", "reasons")


@query("attached_latency", "SELECT c_custkey AS document_id, l.v AS latency_ms FROM customer LEFT JOIN (SELECT user_id, (array_agg(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END ORDER BY event_id DESC))[1] AS v FROM events GROUP BY 1) l ON l.user_id = c_custkey")
def attached_latency(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("o"), F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.col("value").cast("string")).alias("latency"))
    return CO.attach_latency(table(spark, d, "customer").select(F.col("c_custkey").alias("document_id")), log, ["document_id"], "o")


@query("stage_statistics", """SELECT user_id AS document_id, bool_and(event_id % 20 <> 0) AS all_stages_parse_ok, count(*) FILTER (event_type <> 'view') AS verified_items, count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type <> 'view'), 0) AS drop_rate FROM events GROUP BY 1""")
def stage_statistics(spark, d):
    e = table(spark, d, "events").withColumn("document_id", F.col("user_id"))
    items = e.filter("event_type <> 'view'").withColumn("action", F.when(F.col("event_type") == "click", "drop").otherwise("keep"))
    return CO.stage_statistics(items, e.withColumn("parsed", F.col("event_id") % 20 != 0), ["document_id"]).select("document_id", "all_stages_parse_ok", "verified_items", "drop_rate")


# ---- payload shaping --------------------------------------------------------------------


# (form of the response, parse_success, repair_attempted, repair_succeeded, is the event's k in the payload)
RESPONSES = [
    ("{p}", True, False, False, True), ("```json\n{p}\n```", True, False, False, True), ("Here: {c} done", True, True, True, True), ("no json here", False, True, False, False),
    ("{p} and {p}", False, True, False, False), ("{p},{p}", False, True, False, False), ("{d}", True, False, False, True), ("{n}", True, False, False, True),
    ("", False, False, False, False), ("null", False, False, False, False), ("{p}] or [{p}", False, True, False, False), ("{e}", True, True, True, True), ("{x}", True, False, False, True), ("42", True, False, False, False),
]


@query("response_parse", "SELECT event_id, CASE event_id % 14 " + " ".join(f"WHEN {i} THEN {r[1]}" for i, r in enumerate(RESPONSES)) + " END AS parse_success, CASE event_id % 14 "
       + " ".join(f"WHEN {i} THEN {r[2]}" for i, r in enumerate(RESPONSES)) + " END AS repair_attempted, CASE event_id % 14 " + " ".join(f"WHEN {i} THEN {r[3]}" for i, r in enumerate(RESPONSES))
       + " END AS repair_succeeded, CASE WHEN event_id % 14 IN (" + ", ".join(str(i) for i, r in enumerate(RESPONSES) if r[4]) + ") THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def response_parse(spark, d):
    p = F.col("props")
    more = lambda tail: F.concat(F.substring_index(p, "}", 1), F.lit(tail))
    parts = {"p": p, "c": more(",}"), "d": more(', "z": 1, "z": 2}'), "n": more(', "z": "a\nb"}'), "e": F.replace(p, F.lit('"'), F.lit('\\"')), "x": more(', "z": NaN}')}
    text = F.lit(None).cast("string")
    for i, (form, *_) in enumerate(RESPONSES):
        pieces = [parts[x] if x in parts else F.lit(x) for x in re.split(r"\{(\w)\}", form)]
        text = F.when(F.col("event_id") % 14 == i, F.concat(*pieces)).otherwise(text)
    out = PL.parse_responses(table(spark, d, "events").select("event_id", text.alias("text")))
    return out.select("event_id", "parse_success", "repair_attempted", "repair_succeeded", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


@query("event_list_parse", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS n, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
 CASE event_id % 5 WHEN 3 THEN 'not parseable' WHEN 4 THEN 'empty response' END AS error FROM events""")
def event_list_parse(spark, d):
    m, p = F.col("event_id") % 5, F.col("props")
    text = (F.when(m == 0, F.concat(F.lit("```json\n["), p, F.lit(", {}]\n```"))).when(m == 1, F.concat(F.lit('{"note": [1], "events": ['), p, F.lit("]}")))
            .when(m == 2, F.concat(F.lit("Events: ["), p, F.lit(", 1, 2] end"))).when(m == 3, F.concat(F.lit("["), p, F.lit(" and more]"))).otherwise(" "))
    out = PL.parse_event_lists(table(spark, d, "events").select("event_id", text.alias("text")))
    return out.select("event_id", F.json_array_length("events").cast("bigint").alias("n"), F.get_json_object("events", "$[0].k").cast("bigint").alias("k"), "error")


@query("predicted_labels", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2 3 per month' WHEN 1 THEN 'twice a week' ELSE 'unknown' END AS predicted_label, CASE event_id % 3 WHEN 0 THEN 'said so' ELSE '' END AS quote FROM events""")
def predicted_labels(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, '{"label": "2-3 per Month", "quote": "said so"}').when(F.col("event_id") % 3 == 1, '"Twice a week"\nmore').otherwise('{"other": 1}')
    return PL.predicted_labels(PL.parse_responses(table(spark, d, "events").select("event_id", text.alias("text")))).select("event_id", "predicted_label", "quote")


@query("answer_payloads", "SELECT event_id, 'p' || event_id AS path, 'q' AS answer FROM events WHERE event_id % 2 = 0")
def answer_payloads(spark, d):
    e = F.col("event_id")
    text = F.when(e % 2 == 0, F.concat(F.lit('{"groundings": [{"path": "p'), e.cast("string"), F.lit('", "quote": " q "}]}'))).otherwise('{"groundings": []}')
    return PL.grounding_answers(PL.parse_responses(table(spark, d, "events").select("event_id", text.alias("text"))), ["event_id"])


@query("loose_values", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE p_name END AS first, CASE p_partkey % 4 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN 'x|y|z' WHEN 2 THEN '' ELSE p_name END AS items FROM part")
def loose_values(spark, d):
    k = F.col("p_partkey") % 4
    json = (F.when(k == 0, F.concat(F.lit('["'), F.col("p_name"), F.lit('", {"value": "'), F.col("p_type"), F.lit('"}]'))).when(k == 1, '["x; - y", "none", "z"]').when(k == 2, "Not stated").otherwise(F.concat(F.lit('{"name": "'), F.col("p_name"), F.lit('"}'))))
    out = table(spark, d, "part").select("p_partkey", json.alias("j"))
    first = F.when(F.col("p_partkey") % 4 == 1, F.get(PL.loose_items(F.col("j")), F.lit(0))).otherwise(PL.loose_first(F.col("j")))
    return out.select("p_partkey", first.alias("first"), F.array_join(PL.loose_items(F.col("j")), "|").alias("items"))


@query("named_items", "SELECT p_partkey, p_name || ':' || p_type || '|plain:-' AS items FROM part")
def named_items(spark, d):
    json = F.concat(F.lit('[{"label": " '), F.col("p_name"), F.lit('", "support": "'), F.col("p_type"), F.lit('"}, "plain", "none"]'))
    it = PL.named_items(json, ["label", "value"])
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(it, lambda x: F.concat(x["value"], F.lit(":"), F.coalesce(x["quote"], F.lit("-")))), "|").alias("items"))


@query("medication_from_text", "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS dose, 'MG' AS dose_unit, CASE WHEN p_size % 2 = 0 THEN 'twice daily' END AS frequency FROM part")
def medication_from_text(spark, d):
    text = F.concat(F.col("p_name"), F.lit(" (brand), "), F.col("p_size").cast("string"), F.lit(" MG"), F.when(F.col("p_size") % 2 == 0, " twice daily").otherwise(""))
    return table(spark, d, "part").select("p_partkey", R.medication_from_text(text).alias("m")).select("p_partkey", "m.*")


@query("built_fields", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'present' ELSE 'not_stated' END AS scalar_missingness, CASE p_size % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'uncertain' ELSE 'not_stated' END AS result, CASE p_size % 3 WHEN 0 THEN 'completed' ELSE 'not_stated' END AS status FROM part")
def built_fields(spark, d):
    p = table(spark, d, "part")
    s = R.scalar_field(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""))
    i = R.investigation_field(pick(["Normal study", "awaited", "odd"], F.col("p_size")))
    return p.select("p_partkey", s["missingness"].alias("scalar_missingness"), i["result"].alias("result"), i["status"].alias("status"))


def payload_rows(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    meds = pick(['["Keppra 500 mg bd", "lamictal"]', '"Epilim; clobazam"', '"none"'], k)
    types = pick(['["focal seizures", "Partial", "aura"]', '"absence"', "null"], c)
    json = F.concat(F.lit('{"medication_names": '), meds, F.lit(', "seizure_types": '), types, F.lit(', "epilepsy_diagnosis": "JME", "eeg": "normal", "investigations": ["MRI brain abnormal"], "seizure_frequency": "2 per month"}'))
    o = table(spark, d, "orders").select(F.lit("S").alias("system"), F.concat(F.lit("O"), k.cast("string")).alias("document_id"), json.alias("payload"), F.lit("text").alias("text"))
    return o.withColumn("sentences", F.array().cast("array<struct<sentence_id:string,char_start:int,char_end:int,text:string>>"))


@query("payload_projection", f"""SELECT 'O' || o_orderkey AS document_id, {pick_sql(['Keppra:500|lamictal:-', 'Epilim:-|clobazam:-', ''], 'o_orderkey')} AS meds, {pick_sql(['focal seizure', 'generalized absence seizure', ''], 'o_custkey')} AS types, 'JME' AS dx, 'normal' AS eeg, 'abnormal' AS mri, '2 per month' AS frequency FROM orders""")
def payload_projection(spark, d):
    f = F.col("record.fields")
    meds = F.array_join(F.transform(f["current_anti_seizure_medications"], lambda m: F.concat(m["name"], F.lit(":"), F.coalesce(m["dose"], F.lit("-")))), "|")
    return PL.project_payloads(payload_rows(spark, d)).select("document_id", meds.alias("meds"), F.array_join(F.transform(f["seizure_types"], lambda t: t["value"]), "|").alias("types"), f["epilepsy_diagnosis"]["value"].alias("dx"), f["eeg"]["result"].alias("eeg"), f["mri"]["result"].alias("mri"), f["current_seizure_frequency"]["value"].alias("frequency"))


@query("projection_delta_summary", """SELECT 'S' AS system, count(*) AS documents, CAST(sum(greatest(CASE o_custkey % 3 WHEN 0 THEN 2 ELSE 0 END - 1, 0)) AS BIGINT) AS dropped_field_count, CAST(sum(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS added_field_count,
 count(*) FILTER (o_custkey % 3 <> 2) AS seizure_label_changed_documents FROM orders""")
def projection_delta_summary(spark, d):
    rows = PL.project_payloads(payload_rows(spark, d))
    return PL.projection_summary(PL.projection_deltas(rows), ["system"]).select("system", "documents", "dropped_field_count", "added_field_count", "seizure_label_changed_documents")


@query("raw_payload_keys", f"""WITH m AS (SELECT unnest(CASE o_orderkey % 3 WHEN 0 THEN ['levetiracetam', 'lamotrigine'] WHEN 1 THEN ['sodium valproate', 'clobazam'] ELSE [] END) AS key FROM orders), t AS (SELECT unnest(CASE o_custkey % 3 WHEN 0 THEN ['focal seizure', 'aura'] WHEN 1 THEN ['generalized absence seizure'] ELSE [] END) AS key FROM orders)
SELECT 'medication_name' AS metric, key, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'seizure_type', key, count(*) FROM t GROUP BY 2""")
def raw_payload_keys(spark, d):
    keys = PL.raw_metric_keys(payload_rows(spark, d)).distinct().filter(F.col("metric").isin("medication_name", "seizure_type"))
    return keys.groupBy("metric", "key").agg(F.count(F.lit(1)).alias("n"))


@query("sectioned_lines", """WITH l AS (SELECT doc_id, pos, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM (SELECT doc_id, replace(text, '.' || chr(10), ':' || chr(10)) AS text FROM documents))), h AS (SELECT *, contains(line, ':') AS hd FROM l WHERE trim(ltrim(line, '-*•·0123456789. ')) <> '')
SELECT doc_id, count(*) AS lines, count(*) FILTER (hd) AS headers FROM (SELECT *, max(CASE WHEN hd THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS lh FROM h) WHERE lh IS NOT NULL GROUP BY 1""")
def sectioned_lines(spark, d):
    lines = PL.section_lines(table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(":\n")).alias("text")), classify=lambda h: F.lit("any"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_header").alias("headers"))


@query("clinical_sections", "SELECT o_orderkey AS k, pos, field, item FROM orders, (VALUES (0, 'medication_names', 'Keppra'), (1, 'medication_names', 'clobazam'), (2, 'epilepsy_types', 'JME'), (5, 'eeg', 'normal')) v(pos, field, item)")
def clinical_sections(spark, d):
    text = F.lit("**Medications (current)**: Keppra\n- clobazam\nDiagnosis: JME\nPlan: wait\nand see\nEEG: normal")
    return PL.section_lines(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))).select("k", "pos", "field", "item")


@query("canonical_payload_keys", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'medication_names' WHEN 1 THEN 'epilepsy_types' ELSE 'Other' END AS key FROM part")
def canonical_payload_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", PL.clean_key(pick(["Current_Medications (now)", "Epilepsy-Diagnosis", "Other"], F.col("p_partkey"))).alias("key"))


CAND = "cd AS (SELECT user_id AS d, event_type AS task, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS idx, 'v' || event_id AS value, event_id FROM events)"


def candidates(spark, d):
    w = W.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("task"), (F.row_number().over(w) - 1).alias("idx"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), "event_id")


@query("verifier_decisions", f"WITH {CAND} SELECT d AS document_id, task, idx, CASE WHEN d % 3 <> 0 AND event_id % 4 = 0 THEN 'fixed' ELSE value END AS value FROM cd WHERE d % 3 = 0 OR event_id % 2 = 0")
def verifier_decisions(spark, d):
    c = candidates(spark, d)
    dec = c.filter("document_id % 3 <> 0").select("document_id", "task", "idx", F.when(F.col("event_id") % 2 == 0, "keep").otherwise("drop").alias("decision"), F.when(F.col("event_id") % 4 == 0, "fixed").alias("value"))
    return PL.apply_verifier(c.drop("event_id"), dec)


@query("merged_candidates", f"""WITH {CAND}, t AS (SELECT d, CASE task WHEN 'view' THEN 'medication_full_tuple' WHEN 'click' THEN 'medication_names' WHEN 'error' THEN 'seizure_type' WHEN 'signup' THEN 'seizure_frequency' ELSE 'diagnosis_type' END AS task, idx, value FROM cd),
k AS (SELECT *, row_number() OVER (PARTITION BY d, task ORDER BY idx) AS n FROM t WHERE NOT (task = 'medication_names' AND d IN (SELECT d FROM t WHERE task = 'medication_full_tuple')))
SELECT d AS document_id, (CASE task WHEN 'seizure_type' THEN 'ev_s4_type_' WHEN 'seizure_frequency' THEN 'ev_s4_freq_' WHEN 'diagnosis_type' THEN 'ev_s4_dx_' ELSE 'ev_s4_med_' END) || n AS id, value FROM k WHERE task NOT IN ('seizure_frequency', 'diagnosis_type') OR n = 1""")
def merged_candidates(spark, d):
    t = F.col("task")
    c = candidates(spark, d).withColumn("task", F.when(t == "view", "medication_full_tuple").when(t == "click", "medication_names").when(t == "error", "seizure_type").when(t == "signup", "seizure_frequency").otherwise("diagnosis_type"))
    return PL.merge_candidates(c).select("document_id", "id", "value")


_MERGED = f"""{CAND}, t AS (SELECT d, CASE task WHEN 'view' THEN 'medication_full_tuple' WHEN 'click' THEN 'medication_names' WHEN 'error' THEN 'seizure_type' WHEN 'signup' THEN 'seizure_frequency' ELSE 'diagnosis_type' END AS task, idx,
 CASE WHEN task = 'view' THEN 'm' || event_id % 5 ELSE value END AS value, CAST(event_id % 7 AS VARCHAR) AS dose, CASE WHEN event_id % 6 > 0 THEN 'says ' || event_id END AS quote, CASE event_id % 4 WHEN 0 THEN 'previous' WHEN 1 THEN 'planned' END AS temporality FROM cd WHERE d % 4 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY d, task ORDER BY idx) AS n FROM t WHERE NOT (task = 'medication_names' AND d IN (SELECT d FROM t WHERE task = 'medication_full_tuple'))),
e AS (SELECT *, CASE WHEN task LIKE 'medication%' THEN 'medication' ELSE task END AS kind, (CASE task WHEN 'seizure_type' THEN 'ev_s4_type_' WHEN 'seizure_frequency' THEN 'ev_s4_freq_' WHEN 'diagnosis_type' THEN 'ev_s4_dx_' ELSE 'ev_s4_med_' END) || n AS id FROM k WHERE task NOT IN ('seizure_frequency', 'diagnosis_type') OR n = 1),
m AS (SELECT e.*, CASE WHEN kind = 'medication' THEN last_value(dose) OVER w ELSE dose END AS dose1, CASE WHEN kind = 'medication' THEN last_value(quote) OVER w ELSE quote END AS quote1,
 CASE WHEN kind = 'medication' OR temporality IS NULL THEN CASE WHEN kind = 'seizure_type' THEN 'uncertain' ELSE 'current' END WHEN temporality = 'previous' THEN 'historical' ELSE temporality END AS time FROM e WINDOW w AS (PARTITION BY d, task, value ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT d, string_agg(value || ':' || dose1 || ':' || (CASE WHEN quote1 IS NULL THEN 'uncertain' ELSE 'present:' || quote1 END) || ':' || id, '|' ORDER BY n) FILTER (kind = 'medication') AS medications,
 string_agg(value || ':' || time || ':' || (CASE WHEN quote1 IS NULL THEN 'uncertain' ELSE 'present:' || quote1 END) || ':' || id, '|' ORDER BY n) FILTER (kind = 'seizure_type') AS seizure_types,
 max(value || ':' || time || ':' || (CASE WHEN quote1 IS NULL THEN 'uncertain' ELSE 'present' END)) FILTER (kind = 'seizure_frequency') AS frequency, max(value || ':' || time) FILTER (kind = 'diagnosis_type') AS diagnosis,
 string_agg(id || ':' || coalesce(quote1, ''), '|' ORDER BY list_position(['medication_full_tuple', 'medication_names', 'seizure_type', 'seizure_frequency', 'diagnosis_type'], task), n) AS events, bool_or(quote1 IS NULL) AS quoteless FROM m GROUP BY 1)"""


@query("merged_record", f"""WITH {_MERGED} SELECT c_custkey AS document_id, coalesce(medications, '') AS medications, coalesce(seizure_types, '') AS seizure_types, coalesce(frequency, ':uncertain:not_stated') AS frequency, coalesce(diagnosis, ':uncertain') AS diagnosis,
 coalesce(events, '') AS events, NOT coalesce(quoteless, false) AS valid FROM customer LEFT JOIN g ON d = c_custkey""")
def merged_record(spark, d):
    t, e = F.col("task"), F.col("event_id")
    c = candidates(spark, d).filter("document_id % 4 > 0")
    named = F.when(t == "view", "medication_full_tuple").when(t == "click", "medication_names").when(t == "error", "seizure_type").when(t == "signup", "seizure_frequency").otherwise("diagnosis_type")
    c = c.select("document_id", named.alias("task"), "idx", F.when(t == "view", F.concat(F.lit("m"), (e % 5).cast("string"))).otherwise(F.col("value")).alias("value"), (e % 7).cast("string").alias("dose"),
                 F.when(e % 6 > 0, F.concat(F.lit("says "), e.cast("string"))).alias("quote"), F.when(e % 4 == 0, "previous").when(e % 4 == 1, "planned").alias("temporality"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    out = R.check_records(PL.merged_records(docs, c, "merged").withColumn("kept", F.col("record")))
    f, q = F.col("kept.fields"), lambda x: F.when(x["missingness"] == "present", F.concat(F.lit("present:"), x["evidence"][0]["quote"])).otherwise(x["missingness"])
    text = lambda x: F.coalesce(x, F.lit(""))
    return out.select(
        "document_id", F.array_join(F.transform(f["current_anti_seizure_medications"], lambda m: F.concat_ws(":", m["name"], m["dose"], q(m), m["evidence_event_ids"][0])), "|").alias("medications"),
        F.array_join(F.transform(f["seizure_types"], lambda m: F.concat_ws(":", m["value"], m["temporality"], q(m), m["evidence_event_ids"][0])), "|").alias("seizure_types"),
        F.concat_ws(":", text(f["current_seizure_frequency"]["value"]), f["current_seizure_frequency"]["temporality"], f["current_seizure_frequency"]["missingness"]).alias("frequency"),
        F.concat_ws(":", text(f["epilepsy_diagnosis"]["value"]), f["epilepsy_diagnosis"]["temporality"]).alias("diagnosis"),
        F.array_join(F.transform("kept.events", lambda x: F.concat_ws(":", x["id"], x["evidence"]["quote"])), "|").alias("events"), "valid")


# ---- event-first selection --------------------------------------------------------------

CATS = {"view": "medication", "click": "seizure_frequency", "error": "seizure_type", "signup": "investigation", "purchase": "diagnosis"}


def event_rows(spark, d):
    k, e, none = F.get_json_object("props", "$.k").cast("int"), F.col("event_id"), F.lit(None).cast("string")
    t = F.col("event_type")
    cat = F.create_map(*[F.lit(v) for p in CATS.items() for v in p])[t]
    ev = F.struct(F.lit("q").alias("quote"), none.alias("sentence_id"), F.when(e % 2 == 0, F.floor("value").cast("int")).alias("char_start"), F.lit(None).cast("int").alias("char_end"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("document_id"), e.alias("event_idx"), F.concat(F.lit("e"), e.cast("string")).alias("id"), cat.alias("category"), pick(["current", "historical", "planned"], k).alias("temporality"),
        F.when(t == "signup", pick(["completed", "requested"], k)).when(t == "view", pick(["current", "stopped", "increased"], k)).alias("status"),
        F.when(t == "purchase", pick(["epilepsy", "migraine"], k)).when(t == "error", pick(["absence", "shaking", "focal seizures"], k)).otherwise("2 per month").alias("value"), F.when(t == "view", pick(["Keppra", "lamictal"], k)).alias("medication_name"),
        F.when(k % 2 == 0, "500").alias("dose"), none.alias("dose_unit"), none.alias("frequency"), F.when(t == "signup", pick(["EEG", "MRI"], k)).alias("investigation_type"), F.when(t == "signup", pick(["normal", "abnormal", "pending"], k)).alias("result"),
        none.alias("temporal_scope"), F.when(k % 3 == 0, "focal").alias("seizure_type"), ev.alias("evidence"))


EVR = """er AS (SELECT user_id AS d, event_id AS i, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS INT) END AS cs FROM events),
el AS (SELECT *, CASE WHEN t = 'error' THEN i ELSE row_number() OVER (PARTITION BY d, t, CASE WHEN t = 'signup' THEN k % 2 END ORDER BY i) - 1 END AS li FROM er), ep AS (SELECT *, coalesce(cs, li) AS pos FROM el),
rk AS (SELECT d, i, t, CASE t WHEN 'view' THEN 'current_anti_seizure_medications[' || CASE WHEN k % 2 = 0 THEN 'levetiracetam' ELSE 'lamotrigine' END || ']' WHEN 'click' THEN 'current_seizure_frequency' WHEN 'error' THEN 'seizure_types[' || (['generalized absence seizure', 'shaking', 'focal seizure'])[k % 3 + 1] || ']'
 WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'eeg' ELSE 'mri' END ELSE 'epilepsy_diagnosis' END AS field,
 CASE t WHEN 'view' THEN CAST(k % 3 = 0 AS INT) WHEN 'click' THEN CAST(k % 3 = 0 AS INT) WHEN 'error' THEN CAST(k % 3 <> 1 AS INT) WHEN 'signup' THEN CAST(k % 2 = 0 AS INT) ELSE CAST(k % 2 = 0 AS INT) END AS r0,
 CASE t WHEN 'view' THEN CAST(k % 3 = 0 AS INT) WHEN 'click' THEN CAST(k % 3 = 0 AS INT) WHEN 'error' THEN 0 WHEN 'signup' THEN CAST(k % 3 <> 2 AS INT) ELSE CAST(k % 3 = 0 AS INT) END AS r1,
 CASE t WHEN 'view' THEN CAST(k % 2 = 0 AS INT) WHEN 'click' THEN CAST(k % 3 = 0 AS INT) WHEN 'error' THEN 0 WHEN 'signup' THEN CAST(k % 2 = 0 AS INT) ELSE 0 END AS r2, CASE t WHEN 'error' THEN -i ELSE pos END AS r3 FROM ep),
wn AS (SELECT d, field, i, row_number() OVER (PARTITION BY d, field ORDER BY r0 DESC, r1 DESC, r2 DESC, r3 DESC, i) AS rn FROM rk WHERE r0 > 0)"""


@query("event_rank_tuples", f"WITH {EVR} SELECT d AS document_id, 'e' || i AS id, field, r0, r1, r2, r3 FROM rk")
def event_rank_tuples(spark, d):
    r = SEL.ranked_events(event_rows(spark, d))
    return r.select("document_id", "id", "field", "r0", F.when(F.col("category") == "seizure_type", 0).otherwise(F.col("r1")).alias("r1"), "r2", "r3")


@query("ranked_event_selection", f"WITH {EVR} SELECT d AS document_id, field, 'e' || i AS id FROM wn WHERE rn = 1")
def ranked_event_selection(spark, d):
    return SEL.aggregate_events(event_rows(spark, d)).select("document_id", "field", "id")


@query("event_decision_log", f"""WITH {EVR}, w AS (SELECT d, field, i AS wi FROM wn WHERE rn = 1) SELECT rk.d AS document_id, rk.field, 'e' || rk.i AS id, CASE WHEN w.wi = rk.i THEN 'selected' WHEN w.wi IS NULL THEN 'missing' WHEN r0 > 0 THEN 'conflict' ELSE 'discarded' END AS decision FROM rk LEFT JOIN w ON w.d = rk.d AND w.field = rk.field""")
def event_decision_log(spark, d):
    return SEL.event_log(event_rows(spark, d)).select("document_id", "field", "id", "decision")


@query("fields_without_support", f"WITH {EVR} SELECT DISTINCT d AS document_id, field FROM rk WHERE (d, field) NOT IN (SELECT d, field FROM wn)")
def fields_without_support(spark, d):
    r = SEL.ranked_events(event_rows(spark, d))
    return SEL.missing_fields(r, SEL.select_ranked(r, ["document_id", "field"], SEL.RANKS, "event_idx"), ["document_id", "field"])


@query("previous_medications", f"WITH {EVR} SELECT d AS document_id, 'e' || i AS id, CASE WHEN k % 3 = 1 THEN 'stopped' ELSE 'previous' END AS status FROM er WHERE t = 'view' AND k % 3 = 1")
def previous_medications(spark, d):
    return SEL.previous_medications(event_rows(spark, d)).select("document_id", "id", "status")


@query("duplicate_event_ids", "SELECT user_id AS document_id, event_type AS id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_event_ids(spark, d):
    return R.duplicate_event_ids(table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("id")))


@query("loose_event_payload", """WITH e AS (SELECT user_id AS d, event_id AS i, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
m AS (SELECT d, CASE WHEN k % 3 = 1 THEN 'lamotrigine' ELSE 'levetiracetam' END AS v, min(i) AS i FROM e WHERE t = 'view' AND k % 2 = 0 GROUP BY 1, 2), x AS (SELECT d, string_agg(v, '|' ORDER BY i) AS meds FROM m GROUP BY 1), f AS (SELECT d, 'dx' || min(i) AS dx FROM e WHERE t = 'purchase' GROUP BY 1)
SELECT u.d AS document_id, coalesce(meds, '') AS meds, dx FROM (SELECT DISTINCT d FROM e) u LEFT JOIN x USING (d) LEFT JOIN f USING (d)""")
def loose_event_payload(spark, d):
    k, e, t = F.get_json_object("props", "$.k").cast("int"), F.col("event_id"), F.col("event_type")
    rows = table(spark, d, "events").select(F.col("user_id").alias("document_id"), e.alias("ord"), F.when(t == "view", "medication").when(t == "purchase", "diagnosis").otherwise("other").alias("type"),
                                            F.when(t == "purchase", F.concat(F.lit("dx"), e.cast("string"))).alias("value"), F.when(t == "view", pick(["Keppra", "lamictal", "levitiracetam"], k)).alias("name"), (k % 2 == 0).alias("current"))
    out = SEL.loose_event_payload(rows)
    return out.select("document_id", F.coalesce(F.array_join("medication_names", "|"), F.lit("")).alias("meds"), F.col("epilepsy_diagnosis_type").alias("dx"))


@query("event_failure_stages", f"""WITH {EVR}, w AS (SELECT d, field, i AS wi FROM wn WHERE rn = 1), lg AS (SELECT rk.d, rk.field, CASE WHEN w.wi = rk.i THEN 'selected' WHEN w.wi IS NULL THEN 'missing' WHEN r0 > 0 THEN 'conflict' ELSE 'discarded' END AS dc FROM rk LEFT JOIN w ON w.d = rk.d AND w.field = rk.field),
ic AS (SELECT DISTINCT user_id AS d, 'current_seizure_frequency' AS metric FROM events), ns AS (SELECT d, field FROM lg GROUP BY 1, 2 HAVING bool_and(dc = 'missing'))
SELECT ic.d AS document_id, CASE WHEN EXISTS (SELECT 1 FROM ns WHERE ns.d = ic.d AND ns.field = ic.metric) THEN 'extraction_failure_missing_event_support' WHEN EXISTS (SELECT 1 FROM lg WHERE lg.d = ic.d AND dc = 'conflict') THEN 'aggregation_failure_conflict_resolution'
 WHEN EXISTS (SELECT 1 FROM lg WHERE lg.d = ic.d AND dc = 'selected') THEN 'aggregation_failure_or_event_normalization' ELSE 'no_event_first_failure_flagged' END AS stage FROM ic""")
def event_failure_stages(spark, d):
    e = event_rows(spark, d)
    inc = e.select("document_id").distinct().withColumn("metric", F.lit("current_seizure_frequency"))
    return RV.failure_stage(SEL.event_log(e), inc)
