"""Fingerprints of findings, and their merge into canonical findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import ids

BUCKET_MINUTES = 3


def fingerprint_key(minutes: int = BUCKET_MINUTES) -> Column:
    """technique | host | entity | time bucket, from the columns of a flat finding.

    The entity is the process, else the destination address (with its domain), else the file's hash.
    """
    destination = F.concat_ws("|", F.col("dst_ip"), F.when(F.col("dst_ip").isNotNull(), F.col("dst_domain")))
    entity = F.coalesce("process_entity_id", F.when(F.col("dst_ip").isNotNull(), destination), "file_sha256", F.lit("unknown"))
    bucket = F.floor(F.floor(F.col("ts_us") / 1000) / (minutes * 60_000)).cast("string")
    return F.concat_ws("|", F.coalesce("technique_id", F.lit("unknown")), F.coalesce("host_id", F.lit("unknown")), entity, bucket)


def canonical(findings: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """One finding for each fingerprint, without those that have no time.

    Of several, the one with the greatest (confidence, severity, time) wins, ties going to the smallest event_id; providers and evidence are
    united, severity is the greatest, and each provider adds 0.1 to the winner's confidence, up to 1. A lone finding
    keeps its own. Partial aggregation leaves one row a fingerprint and task to shuffle, so a flood of equal
    findings makes no hot task; the united sets hold distinct values only.
    """
    rows = findings.where("ts_us IS NOT NULL").withColumn("key", fingerprint_key(minutes))
    evidence = F.coalesce("evidence_ids", F.array("event_id")) if "evidence_ids" in findings.columns else F.array("event_id")
    first = F.struct((-F.col("confidence")).alias("c"), (-F.col("severity")).alias("s"), (-F.col("ts_us")).alias("t"), F.col("event_id").alias("e"))
    winner = F.struct("event_id", "confidence", "ts_us", "host_id", "technique_id", "tactic_id")
    out = rows.groupBy("key").agg(
        F.min_by(winner, first).alias("w"), F.array_sort(F.collect_set("provider")).alias("providers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(evidence)))).alias("evidence_ids"),
        F.max("severity").alias("severity"), F.count(F.lit(1)).alias("n_merged"),
    )
    raised = F.least(F.col("w.confidence") + 0.1 * F.size("providers"), F.lit(1.0))
    return out.select(
        F.col("w.event_id").alias("event_id"), ids.fingerprint_id(F.col("key")).alias("fingerprint"), F.lit("finding.canonical").alias("dataset"),
        "w.host_id", "w.technique_id", "w.tactic_id", "w.ts_us", "severity",
        F.when(F.col("n_merged") > 1, raised).otherwise(F.col("w.confidence")).alias("confidence"), "providers", "evidence_ids", "n_merged",
    )


def merged_alternative(findings: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """The plainer merge: the earliest finding is the base, confidence is 0.5 + 0.15 a finding up to 1."""
    rows = findings.where("ts_us IS NOT NULL").withColumn("key", fingerprint_key(minutes))
    out = rows.groupBy("key").agg(
        F.min_by("event_id", F.struct("ts_us", "event_id")).alias("base_event_id"), F.array_sort(F.collect_set("provider")).alias("providers"),
        F.max("severity").alias("severity"), F.count(F.lit(1)).alias("n_merged"),
    )
    confidence = F.least(F.lit(0.5) + F.lit(0.15) * F.col("n_merged"), F.lit(1.0))
    return out.select(ids.canonical_id(F.col("key")).alias("event_id"), "base_event_id", "providers", "severity", confidence.alias("confidence"), "n_merged")


def provider(providers: Column, dataset: Column) -> Column:
    """The first provider, else correlation_rules for a correlated dataset, else unknown."""
    first = F.try_element_at(providers, F.lit(1))
    return F.coalesce(first, F.when(F.contains(dataset, F.lit("correlat")), "correlation_rules"), F.lit("unknown"))
