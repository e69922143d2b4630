"""Ungrounded claims of the clinic corpus through the batched answer hook."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from goldmeter.operators import answers as AN
from goldmeter.operators import grounding as G
from goldmeter.session import ensure_checkpoint_dir
from verify import clinic as C
from verify.base import query


def _frequency_words(batch: list[dict]) -> list[str | None]:
    """The stand-in for an answerer: reads the statement after "Seizures: ", makes one up for diagnoses."""
    return [r["text"].split("Seizures: ")[1].split(".")[0] if r["category"] == "frequency" else "words of nobody" for r in batch]


@query("batched_answers", f"""WITH {C.BASE}, cl AS (SELECT document_id, fq, v.system, v.path FROM bl, (VALUES ('A', 'f'), ('B', 'f'), ('A', 'd')) v(system, path))
SELECT system, document_id, path, CASE WHEN path = 'f' AND fq <> '' THEN 'fallback' ELSE 'ungrounded' END AS grounded_by, CASE WHEN path = 'f' AND fq <> '' THEN fq END AS quote FROM cl""")
def batched_answers(spark, d):
    """Two systems claim the same of each letter, so it is asked once; answers that the letter does not hold are refused."""
    letters = C.letters(spark, d)
    claim = F.struct(F.lit("A").alias("system"), F.lit("f").alias("path"), F.lit("frequency").alias("category"))
    three = F.array(claim, claim.withField("system", F.lit("B")), claim.withField("path", F.lit("d")).withField("category", F.lit("diagnosis")))
    claims = letters.select("document_id", F.inline(three)).withColumn("value", F.lit("often"))
    claims = claims.withColumn("quote", F.lit(None).cast("string")).withColumn("grounded_by", F.lit("ungrounded"))
    requests = AN.claim_requests(claims, letters)
    store = f"{ensure_checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    answers = AN.answer_requests(requests, _frequency_words, store, most=512)
    found = AN.answered_claims(requests, answers, ["system", "document_id"])
    return G.apply_answers(claims.drop("category", "value"), found, letters, ["system", "document_id"])
