"""The ingest job as a stream: normalise, drop repeats, store by table, canonicalise, project to the graph.

Tables are keyed ones (``store``): each batch is a commit, a fingerprint's, node's or edge's last state counts, and a batch
that is tried again replaces its own rows. Findings are merged in the state of a stream of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from sentrylake.functions import ids
from sentrylake.operators import findings, graph
from sentrylake.operators.normalize import normalized
from sentrylake.operators.store import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long the state of a fingerprint stays after its last finding.
TTL_MS = 7 * 24 * 3600 * 1000


def flat(rows: DataFrame) -> DataFrame:
    """Normalised rows with ts_us and provider, as findings and the graph take them."""
    return rows.withColumn("ts_us", F.unix_micros("ts")).withColumn("provider", F.try_element_at("providers", F.lit(1)))


def normalized_stream(lines: DataFrame, horizon: str = "7 days") -> DataFrame:
    """A stream of good rows, each id once within ``horizon`` of its arrival; rows may be late by any time.

    The watermark is on the time of ingestion, so a sensor with a fast clock makes no other row late. Every batch reports
    its lines, bytes and dropped rows as the observation ``tick``.
    """
    rows = normalized(lines)
    seen = rows.observe("tick", F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"), F.count("drop_reason").alias("dropped"))
    return seen.where("drop_reason IS NULL").withWatermark("ingested", horizon).dropDuplicatesWithinWatermark(["event_id"])


def ticks(query: StreamingQuery) -> list[dict]:
    """batch, lines, bytes and dropped of the query's recent batches."""
    seen = [(p["batchId"], (p.get("observedMetrics") or {}).get("tick")) for p in query.recentProgress]
    return [{"batch": b, "lines": t["lines"] or 0, "bytes": t["bytes"] or 0, "dropped": t["dropped"] or 0} for b, t in seen if t]


def store(rows: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends a stream of normalised rows to one table, partitioned by its target and the day it came in."""
    to = rows.withColumn("ingest_date", F.to_date("ingested"))
    writer = to.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).partitionBy("target_table", "ingest_date")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def canonical_rows(raw: DataFrame) -> DataFrame:
    """Canonical findings of flat raw ones, with the other fields of the finding that won, as the graph takes them."""
    merged = findings.canonical(raw)
    new = {"dataset", "severity", "confidence", "providers", "evidence_ids", "fingerprint", "n_merged"}
    rest = [c for c in raw.columns if c not in new and c != "event_id"]
    return merged.select("event_id", *sorted(new)).join(raw.select("event_id", *rest).dropDuplicates(["event_id"]), "event_id")


def batch_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """What normalised rows come to, taken by themselves: events, raw findings, canonical findings, nodes and edges."""
    rows = flat(batch)
    raw = rows.where("target_table = 'raw_findings'").withColumn("fingerprint", ids.fingerprint_id(findings.fingerprint_key()))
    given = rows.where("target_table = 'canonical_findings'").withColumn("fingerprint", F.col("event_id")).withColumn("n_merged", F.lit(1).cast("long"))
    canonical = canonical_rows(raw).unionByName(given, allowMissingColumns=True)
    events = rows.where("target_table = 'events'")
    linked = events.unionByName(canonical, allowMissingColumns=True)
    return {"events": events, "raw_findings": raw, "canonical_findings": canonical, "nodes": graph.nodes(linked), "edges": graph.edges(linked)}


def _last_named(rows: DataFrame) -> DataFrame:
    """Nodes by uid: the last mention, and the last name that one had."""
    named = F.when(F.col("name").isNotNull(), F.struct("name_us", "_seq", "name"))
    return rows.groupBy("uid").agg(F.first("ntype").alias("ntype"), F.max("ts_us").alias("ts_us"), F.max_by("name", named).alias("name"), F.max("name_us").alias("name_us"))


def tables(spark: SparkSession, out: str, buckets: int = 64) -> dict[str, KeyedTable]:
    """The job's tables at ``out``: events and raw findings by id, canonical findings by fingerprint, nodes by uid, edges by their key."""
    empty = batch_tables(normalized(spark.createDataFrame([], "value string")).where("drop_reason IS NULL"))
    keys = {"events": ["event_id"], "raw_findings": ["event_id"], "canonical_findings": ["fingerprint"], "nodes": ["uid"], "edges": graph.EDGE_KEY}
    return {n: KeyedTable(spark, f"{out}/{n}", keys[n], empty[n].schema, buckets, merge=_last_named if n == "nodes" else None) for n in keys}


def current(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables as they stand; alarms of findings that were superseded go. Each is a committed state, whatever is being written."""
    found = {n: t.read() for n, t in tables(spark, out).items()}
    winners = found["canonical_findings"].select("fingerprint", "event_id")
    edges = found["edges"]
    edges = edges.where("NOT is_alarm").unionByName(edges.where("is_alarm").join(winners, ["fingerprint", "event_id"], "left_semi").select(edges.columns))
    return found | {"nodes": found["nodes"].drop("name_us"), "edges": edges}


def compact(spark: SparkSession, out: str, most: int = 8) -> dict[str, int]:
    """Puts buckets that lie in more than so many batches' folders together; to be run now and then beside the job."""
    return {n: t.compact(most) for n, t in tables(spark, out).items()}


class Merge(StatefulProcessor):
    """Of each fingerprint the winner (as JSON), its place in the order, providers, evidence, severity and number; and the ids merged."""

    STATE = "winner string, confidence double, severity int, ts_us long, event_id string, top int, n long, providers array<string>, evidence array<string>"
    OUT = "fingerprint string, winner string, confidence double, severity int, n_merged long, providers array<string>, evidence_ids array<string>"

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.merged = handle.getValueState("merged", self.STATE, self.ttl_ms)
        self.ids = handle.getMapState("ids", "id string", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, top, n, who, evidence, fresh = None, None, 0, set(), set(), False
        if self.merged.exists():
            winner, c, s, t, e, top, n, names, ids_ = self.merged.get()
            best, who, evidence = ((-c, -s, -t, e), winner), set(names), set(ids_)
        for batch in rows:
            for event, c, s, t, provider, proof, row in batch[["event_id", "confidence", "severity", "ts_us", "provider", "evidence_ids", "row"]].itertuples(index=False):
                if self.ids.containsKey((event,)):
                    continue
                self.ids.updateValue((event,), (True,))
                c, s = 0.0 if pd.isna(c) else float(c), 0 if pd.isna(s) else int(s)
                mine = ((-c, -s, -int(t), str(event)), row)
                best = mine if best is None or mine[0] < best[0] else best
                top, n, fresh = max(s, top or 0), n + 1, True
                who |= {provider} - {None}
                evidence |= set(proof) if proof is not None else {event}
        if not fresh:
            return
        (c, s, t, e), winner = best
        providers, proofs = sorted(who), sorted(evidence)
        self.merged.update((winner, -c, -s, -t, e, top, n, providers, proofs))
        raised = min(-c + 0.1 * len(providers), 1.0) if n > 1 else -c
        yield pd.DataFrame({"fingerprint": [key[0]], "winner": [winner], "confidence": [raised], "severity": [top], "n_merged": [n], "providers": [providers], "evidence_ids": [proofs]})

    def close(self) -> None:
        pass


def merged_findings(rows: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of normalised raw findings to a stream of canonical ones, whole rows with evidence, merged in a state for each
    fingerprint. An id counts once. State goes ``ttl_ms`` after its last change; the state store must be RocksDB.
    """
    raw = flat(rows).where("ts_us IS NOT NULL").withColumn("fingerprint", ids.fingerprint_id(findings.fingerprint_key()))
    new = ["dataset", "severity", "confidence", "providers", "evidence_ids", "fingerprint"]
    rest = [c for c in raw.columns if c not in new]
    asked = raw.select("fingerprint", "event_id", "confidence", "severity", "ts_us", "provider", "evidence_ids", F.to_json(F.struct(*rest)).alias("row"))
    out = asked.groupBy("fingerprint").transformWithStateInPandas(Merge(ttl_ms), Merge.OUT, "Update", "ProcessingTime")
    won = F.from_json("winner", StructType([raw.schema[c] for c in rest]))
    return out.select(won.alias("w"), *[c for c in out.columns if c != "winner"], F.lit("finding.canonical").alias("dataset")).select("w.*", *new, "n_merged")


@dataclass
class Ingest:
    """The two queries of the job, which read the same lines: one for rows as they come, one for what findings merge to."""

    rows: StreamingQuery
    merged: StreamingQuery

    def await_termination(self, seconds: int | None = None) -> None:
        for q in (self.rows, self.merged):
            q.awaitTermination(seconds) if seconds else q.awaitTermination()
            if q.exception() is not None:
                raise q.exception()

    def stop(self) -> None:
        self.rows.stop()
        self.merged.stop()


def run(lines: DataFrame, out: str, checkpoint: str, interval: str | None = None, horizon: str = "7 days", ttl_ms: int = TTL_MS) -> Ingest:
    """The whole job. Each batch is a commit of each table, under its number, so a batch that is tried again replaces its own
    rows. Canonical findings come from state, not from stored findings, and what the batch changes is projected to the graph.
    """
    spark = lines.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")
    to = tables(spark, out)

    def add(parts: dict[str, DataFrame], number: int) -> None:
        for name, df in parts.items():
            to[name].append(df, number)

    def rows_tick(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            rows = flat(batch)
            events = rows.where("target_table = 'events'")
            raw = rows.where("target_table = 'raw_findings'").withColumn("fingerprint", ids.fingerprint_id(findings.fingerprint_key()))
            given = rows.where("target_table = 'canonical_findings'").withColumn("fingerprint", F.col("event_id")).withColumn("n_merged", F.lit(1).cast("long"))
            linked = events.unionByName(given, allowMissingColumns=True)
            add({"events": events, "raw_findings": raw, "canonical_findings": shaped(given, to["canonical_findings"]), "nodes": graph.nodes(linked), "edges": shaped(graph.edges(linked), to["edges"])}, 2 * number)
        finally:
            batch.unpersist()

    def merged_tick(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            add({"canonical_findings": shaped(batch, to["canonical_findings"]), "nodes": graph.nodes(batch), "edges": shaped(graph.edges(batch), to["edges"])}, 2 * number + 1)
        finally:
            batch.unpersist()

    def started(stream: DataFrame, mode: str, tick, name: str) -> StreamingQuery:
        writer = stream.writeStream.outputMode(mode).foreachBatch(tick).option("checkpointLocation", f"{checkpoint}/{name}")
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    raw = normalized(lines).where("drop_reason IS NULL AND target_table = 'raw_findings'")
    rows = started(normalized_stream(lines, horizon), "append", rows_tick, "rows")
    # state that ends by the clock would ask for batches without data, one after the other and for ever
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle, "true")
    spark.conf.set(idle, "false")
    try:
        return Ingest(rows, started(merged_findings(raw, ttl_ms), "update", merged_tick, "merged"))
    finally:
        spark.conf.set(idle, before)


def shaped(df: DataFrame, table: KeyedTable) -> DataFrame:
    """df with the table's columns; those that it lacks are null."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])
