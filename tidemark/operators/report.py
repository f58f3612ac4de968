"""What a reader sees: notes from templates, the digest, review queues, summaries and the audit that must find nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import ladders as L
from tidemark.operators import trust
from tidemark.operators.prefix import numbered

def action(signal: Column, name: Column, signals: Column) -> Column:
    """What to do about a finding of each class."""
    has = lambda s: F.array_contains(signals, s)
    retired = F.when(has("model_tier_restricted"), "%s is served on a quote-only tier alone: replace the model id.").when(has("model_shutdown_passed"), "%s is retired at its provider: replace the model id.").otherwise("%s is to be retired: plan the change of model id.")
    lines = {
        "S1": "Repoint or replace the dead links to %s.", "S2": "Check whether the step for %s still works without an account.", "S3": "Check the free tier of %s against what the session asks for.",
        "S4": "%s looks abandoned: plan a replacement.", "S5": "Go through the steps for %s again; click paths may be stale.", "S6": "Run the session's code again with the current %s.",
        "S8": "The docs of %s changed: spot-check screenshots.", "S9": "Import the workflow of %s again and confirm what the node does.", "S10": "Consider whether a better tool than %s is there now.", "S11": "Review coverage.",
    }
    return F.replace(F.when(signal == "S7", retired).otherwise(L.lookup(lines, signal)), F.lit("%s"), name)


def noted(found: DataFrame, today: Column) -> DataFrame:
    """Findings with what, why and when to act, and a due date."""
    scope = F.concat_ws(", ", F.when(F.col("questions_executing") > 0, F.concat(F.col("questions_executing"), F.lit(" graded item(s) execute it"))), F.when(F.col("blast_radius") > 0, F.concat(F.lit("blast radius "), F.col("blast_radius"))))
    return found.withColumns({"what": action(F.col("signal"), F.col("canonical_name"), F.col("probe_signals")), "scope": scope, "when": L.lookup(K.WHEN_TO_ACT, F.col("severity")), "due_by": L.due_date(F.col("severity"), today)})


def digest_lines(notes: DataFrame) -> DataFrame:
    """place, line: one line a finding, worst first; findings that didn't change stay out."""
    order = [L.rank_of(F.col("severity"), K.SEVERITIES).desc(), F.col("blast_radius").desc(), F.col("finding_id").asc()]
    shown = notes.filter("diff_class <> 'unchanged'") if "diff_class" in notes.columns else notes
    line = F.format_string("%s · %s %s — %s · blast radius %d · %s", F.upper("severity"), "signal", "label", "canonical_name", "blast_radius", "what")
    return numbered(shown, order).select("place", line.alias("line"))


def digest(lines: DataFrame) -> DataFrame:
    """One row: the whole text of a digest."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


def review_queue(candidates: DataFrame, most: int = 400) -> DataFrame:
    return candidates.orderBy(F.col("n").desc(), "name").limit(most)


def audit(claims: DataFrame) -> DataFrame:
    """Claims whose stored tier isn't what the cascade says now, or that claim more than their tier may settle. Must be empty.

    claims(claim_id, source_url, own_domains, kind, tier, substantiates).
    """
    again = trust.tier(F.col("source_url"), F.col("own_domains"), F.col("kind"))
    wrong = F.when(F.col("tier") != again, "tier differs").when(F.col("substantiates") & ~trust.substantiates(again, F.col("kind")), "cannot substantiate")
    return claims.withColumn("violation", wrong).filter("violation IS NOT NULL").select("claim_id", "violation")


def overview(findings: DataFrame) -> DataFrame:
    """course, findings, worst, regressions, radius of projected findings."""
    worst = F.max(L.rank_of(F.col("severity"), K.SEVERITIES))
    return findings.groupBy("course").agg(F.count(F.lit(1)).alias("findings"), F.element_at(F.array(*[F.lit(s) for s in K.SEVERITIES]), worst + 1).alias("worst"), F.sum("blast_radius").alias("radius"))
