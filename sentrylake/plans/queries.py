"""Queries of the engine's operators over the bridged events and the other tables, and the SQL that each must equal.

Doubles are rounded to six places on both sides; lists are joined texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import attack, ids, texts
from sentrylake.functions.times import bucket, parse_time
from sentrylake.operators import correlate, correlation_rules, detect, findings, fsa, graph, killchain, normalize, reports, sensors, tables, ttp
from sentrylake.plans.bridge import UTC_TS, duck, ecs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def listed(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


KEY = """concat_ws('|', technique_id, host_id, coalesce(process_entity_id, CASE WHEN dst_ip IS NOT NULL THEN concat_ws('|', dst_ip, dst_domain) END, file_sha256, 'unknown'),
  cast(ts_us // 1000 // ({m} * 60000) AS VARCHAR))"""
CANONICAL = """f AS (SELECT *, {key} AS key FROM ecs WHERE kind = 'alert'),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, severity DESC, ts_us DESC, event_id) AS rn FROM f),
c AS (SELECT max(CASE WHEN rn = 1 THEN event_id END) AS event_id, 'fp-' || sha1(key) AS fingerprint, 'finding.canonical' AS dataset, max(CASE WHEN rn = 1 THEN host_id END) AS host_id,
  max(CASE WHEN rn = 1 THEN technique_id END) AS technique_id, max(CASE WHEN rn = 1 THEN tactic_id END) AS tactic_id, max(CASE WHEN rn = 1 THEN ts_us END) AS ts_us, max(severity) AS severity,
  CASE WHEN count(*) > 1 THEN least(max(CASE WHEN rn = 1 THEN confidence END) + 0.1::DOUBLE * count(DISTINCT provider), 1.0) ELSE max(confidence) END AS confidence,
  array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS evidence_ids, count(*) AS n_merged FROM r GROUP BY key)"""
CANONICAL_OUT = "SELECT event_id, fingerprint, dataset, host_id, technique_id, tactic_id, ts_us, severity, round(confidence, 6) AS confidence, providers, evidence_ids, n_merged FROM c"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecs(spark, sf_dir).where("kind = 'alert'")


def _canonical(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    out = findings.canonical(_alerts(spark, sf_dir), minutes)
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("providers", F.array_join("providers", ",")).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(duck(CANONICAL.format(key=KEY.format(m=3))) + CANONICAL_OUT)
def canonical_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir, 3)


@query(duck(CANONICAL.format(key=KEY.format(m=1440))) + CANONICAL_OUT)
def canonical_findings_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with buckets of a day, so that many findings merge."""
    return _canonical(spark, sf_dir, 1440)


@query(duck(f"x AS (SELECT event_id, {KEY.format(m=3)} AS fingerprint_key FROM ecs) SELECT event_id, fingerprint_key, 'fp-' || sha1(fingerprint_key) AS fingerprint FROM x"))
def fingerprint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecs(spark, sf_dir).select("event_id", findings.fingerprint_key().alias("fingerprint_key")).withColumn("fingerprint", ids.fingerprint_id(F.col("fingerprint_key")))


@query(duck(f"""f AS (SELECT *, {KEY.format(m=1440)} AS key FROM ecs WHERE kind = 'alert')
SELECT 'canonical-' || substr(sha256(key), 1, 16) AS event_id, arg_min(event_id, (ts_us, event_id)) AS base_event_id, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, max(severity) AS severity,
  round(least(0.5 + 0.15::DOUBLE * count(*), 1.0), 6) AS confidence, count(*) AS n_merged FROM f GROUP BY key"""))
def merge_findings_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.merged_alternative(_alerts(spark, sf_dir), 1440).select("event_id", "base_event_id", listed("providers"), "severity", r6("confidence"), "n_merged")


@query(duck("x AS (SELECT 1) SELECT event_id, CASE WHEN k % 2 = 0 THEN provider WHEN k % 3 = 0 THEN 'correlation_rules' ELSE 'unknown' END AS provider FROM ecs"))
def provider_of_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("k") % 2 == 0, F.array("provider")).otherwise(F.array().cast("array<string>"))
    dataset = F.when(F.col("k") % 3 == 0, "finding.correlated.lateral_movement").otherwise("finding.raw.falco")
    return ecs(spark, sf_dir).select("event_id", findings.provider(given, dataset).alias("provider"))


@query(duck("""x AS (SELECT 1) SELECT event_id, 'h-' || substr(sha1(host_name), 1, 16) AS host_id, 'p-' || substr(sha1(host_id || ':' || k || ':' || ts_us || ':' || process_name), 1, 16) AS process_entity_id,
  'sess-' || substr(sha1(host_id || ':' || user_name || ':' || coalesce(dst_ip, '') || ':' || cast(ts_us // 1000000 // 300 AS VARCHAR)), 1, 16) AS session_id,
  substr(sha256(ts_us || '|' || host_name || '|' || action), 1, 16) AS import_id, 'rule-' || substr(sha1(action), 1, 16) AS rule_id, sha256(user_name) AS token_hash FROM ecs"""))
def host_process_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return ecs(spark, sf_dir).select(
        "event_id", ids.host_id(c("host_name")).alias("host_id"), ids.process_entity_id(c("host_id"), c("k"), c("ts_us"), c("process_name")).alias("process_entity_id"),
        ids.session_id(c("host_id"), c("user_name"), c("dst_ip"), F.floor(c("ts_us") / 1000000)).alias("session_id"), ids.import_event_id(c("ts_us"), c("host_name"), c("action")).alias("import_id"),
        ids.rule_id(F.lit(None).cast("string"), c("action")).alias("rule_id"), ids.token_hash(c("user_name")).alias("token_hash"),
    )


@query("SELECT event_id AS n, 'evt-' || substr(sha1(props || event_type), 1, 16) AS event_id FROM events")
def event_id_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("n"), ids.event_id(F.lit(None).cast("string"), F.concat("props", "event_type")).alias("event_id"))


@query("""SELECT event_id AS n, epoch_us(ts) // 1000000 * 1000000 AS from_seconds, epoch_us(ts) // 1000 * 1000 AS from_millis, epoch_us(ts) AS from_iso, NULL::BIGINT AS from_text, epoch_us(ts) // 1000 // 180000 AS bucket FROM events""")
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.expr(UTC_TS))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    of = lambda c: F.unix_micros(parse_time(c))
    return e.select(F.col("event_id").alias("n"), of(F.floor(us / 1000000)).alias("from_seconds"), of(F.floor(us / 1000)).alias("from_millis"), of(iso).alias("from_iso"), of(F.lit("yesterday")).alias("from_text"), bucket(F.floor(us / 1000), 3).alias("bucket"))


def _raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridged events as the sensors would send them: some dotted, some without a host, time or known dataset."""
    e = ecs(spark, sf_dir)
    c = F.col
    nested = F.to_json(F.struct(
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("@timestamp"),
        F.struct(c("event_id").alias("id"), c("kind").alias("kind"), F.when(c("k") % 11 == 5, "unheard.of").otherwise(c("dataset")).alias("dataset"), c("severity").cast("string").alias("severity"), c("action").alias("action")).alias("event"),
        F.struct(F.when(c("k") % 13 != 7, c("host_name")).alias("name")).alias("host"), F.struct(c("user_name").alias("name")).alias("user"),
        F.array(F.concat(F.lit("attack."), F.lower("technique_id"))).alias("tags"),
    ))
    flat = F.to_json(F.struct(
        F.floor(c("ts_us") / 1000).cast("string").alias("@timestamp"), c("event_id").alias("event.id"), c("kind").alias("event.kind"), c("dataset").alias("event.dataset"), c("severity").alias("event.severity"),
        c("host_name").alias("host.name"), c("action").alias("event.action"), c("user_name").alias("user.name"), F.array(F.lit("attack.execution"), F.lit("attack.t1059.004")).alias("tags"),
    ))
    return e.select(F.when(c("k") % 17 == 3, "{broken").when(c("k") % 2 == 0, nested).otherwise(flat).alias("value"))


_NORMAL = """x AS (SELECT *, CASE WHEN k % 2 = 0 THEN ts_us ELSE ts_us // 1000 * 1000 END AS t, CASE WHEN k % 17 = 3 THEN 'invalid_json' WHEN k % 2 = 0 AND k % 11 = 5 THEN 'bad_dataset' WHEN k % 2 = 0 AND k % 13 = 7 THEN 'no_host' END AS drop_reason FROM ecs)"""


@query(duck(_NORMAL + """ SELECT event_id, t AS ts_us, kind, dataset, host_name, host_id, user_name, action, CASE WHEN kind = 'alert' THEN severity END AS severity,
  CASE WHEN kind = 'alert' THEN CASE WHEN k % 2 = 0 THEN tactic_id ELSE 'TA0002' END END AS tactic_id, CASE WHEN kind = 'alert' THEN CASE WHEN k % 2 = 0 THEN technique_id ELSE 'T1059.004' END END AS technique_id,
  CASE WHEN kind = 'alert' THEN 'raw_findings' ELSE 'events' END AS target_table, CASE WHEN kind = 'alert' THEN event_id END AS evidence FROM x WHERE drop_reason IS NULL"""))
def normalize_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.normalized(_raw_json(spark, sf_dir)).where("drop_reason IS NULL")
    return out.select("event_id", F.unix_micros("ts").alias("ts_us"), "kind", "dataset", "host_name", "host_id", "user_name", "action", "severity", "tactic_id", "technique_id", "target_table", F.array_join("evidence_ids", ",").alias("evidence"))


@query(duck(_NORMAL + """ SELECT coalesce('dropped:' || drop_reason, CASE WHEN kind = 'alert' THEN 'raw_findings' ELSE 'events' END) AS outcome, count(*) AS n FROM x GROUP BY 1"""))
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.normalized(_raw_json(spark, sf_dir))
    return out.groupBy(F.coalesce(F.concat(F.lit("dropped:"), "drop_reason"), "target_table").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(duck("""x AS (SELECT *, CASE k % 5 WHEN 0 THEN 'T1059.004' WHEN 1 THEN 'T1078' WHEN 2 THEN NULL WHEN 3 THEN 'T9999' ELSE 'T1021' END AS t FROM ecs)
SELECT event_id, CASE WHEN k % 7 = 0 THEN 'TA0003' WHEN t = 'T1059.004' THEN 'TA0002' WHEN t = 'T1078' THEN 'TA0001' WHEN t = 'T1021' THEN 'TA0008' ELSE 'TA0000' END AS tactic_id, coalesce(t, 'T0000') AS technique_id FROM x"""))
def attack_tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(*map(F.lit, ["attack.t1059.004", " ATTACK.T1078", "benign", "attack.t9999", "t1021"])), (F.col("k") % 5 + 1).cast("int"))
    tags = F.when(F.col("k") % 7 == 0, F.array(tag, F.lit("attack.persistence"))).otherwise(F.array(tag))
    return ecs(spark, sf_dir).select("event_id", normalize.attack_tags(tags).alias("a")).select("event_id", "a.tactic_id", "a.technique_id")


@query(duck("x AS (SELECT *, 'id-' || (k * 100 + n % 100) AS id FROM ecs), s AS (SELECT DISTINCT id FROM x WHERE n % 10 = 0) SELECT id AS event_id, min(ts_us) AS ts_us, arg_min(n, (ts_us, n)) AS n FROM x WHERE n % 10 <> 0 AND id NOT IN (SELECT id FROM s) GROUP BY id"))
def dedup_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows not stored yet, the first of each id (here ids are made to repeat, and a tenth of the rows is what is stored)."""
    rows = ecs(spark, sf_dir).select(F.concat(F.lit("id-"), (F.col("k") * 100 + F.col("n") % 100).cast("string")).alias("event_id"), "ts_us", "n")
    fresh = normalize.first_by_id(rows.where("n % 10 <> 0"), [F.col("ts_us"), F.col("n")])
    return normalize.not_stored(fresh, rows.where("n % 10 = 0"))


# --- graph

_GRAPH_SQL = """g AS (SELECT *, 'Host:host.id=' || host_id AS h, 'User:user.id=' || user_id AS u, CASE WHEN process_entity_id IS NOT NULL THEN 'Process:process.entity_id=' || process_entity_id END AS p,
  CASE WHEN file_sha256 IS NOT NULL THEN 'File:file.path=/f/' || k || ';host.id=' || host_id END AS f, CASE WHEN dst_ip IS NOT NULL THEN 'IP:ip=' || dst_ip END AS i, CASE WHEN dst_domain IS NOT NULL THEN 'Domain:domain.name=' || dst_domain END AS d,
  CASE WHEN kind = 'alert' THEN 'finding.canonical' ELSE dataset END AS ds FROM ecs),
edges AS (SELECT src_uid, dst_uid, rtype, event_id, ts_us, kind = 'alert' AS is_alarm, tactic_id, technique_id, severity, kind, ds, action, confidence, k, provider FROM (
  SELECT g.*, u AS src_uid, h AS dst_uid, 'LOGON' AS rtype FROM g WHERE ds = 'hostlog.auth' UNION ALL SELECT g.*, p, h, 'RUNS_ON' FROM g WHERE ds = 'hostlog.process' UNION ALL
  SELECT g.*, p, f, 'FILE_ACCESS' FROM g WHERE ds = 'hostbehavior.file' UNION ALL SELECT g.*, coalesce(p, h), i, 'NET_CONNECT' FROM g WHERE ds = 'netflow.flow' OR kind = 'alert' UNION ALL
  SELECT g.*, coalesce(p, h), d, 'DNS_QUERY' FROM g WHERE ds = 'netflow.dns' UNION ALL SELECT g.*, d, i, 'RESOLVES_TO' FROM g WHERE ds = 'netflow.dns' UNION ALL
  SELECT g.*, d, 'IP:ip=10.9.9.' || (k % 3), 'RESOLVES_TO' FROM g WHERE ds = 'netflow.dns' AND dst_ip IS NOT NULL UNION ALL
  SELECT g.*, h, 'IP:ip=' || host_ip, 'HAS_IP' FROM g) WHERE src_uid IS NOT NULL AND dst_uid IS NOT NULL)"""


def _graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ecs(spark, sf_dir)
    alert = F.col("kind") == "alert"
    return e.select(
        "n", "k", "event_id", "ts_us", "kind", F.when(alert, "finding.canonical").otherwise(F.col("dataset")).alias("dataset"), "action", "host_id", "host_name", "user_id", "user_name", "process_entity_id", "process_name",
        F.lit(None).cast("string").alias("parent_entity_id"), F.when(F.col("file_sha256").isNotNull(), F.concat(F.lit("/f/"), F.col("k").cast("string"))).alias("file_path"), "dst_ip", "dst_domain", F.array("host_ip").alias("host_ips"),
        F.when(alert, F.array(F.lit("network"))).alias("category"), F.array("event_id").alias("evidence_ids"), "tactic_id", "technique_id", "severity", "confidence", F.array("provider").alias("providers"),
        F.when(F.col("dst_ip").isNotNull(), F.array(F.col("dst_ip"), F.concat(F.lit("10.9.9."), (F.col("k") % 3).cast("string")))).alias("dns_answers"), F.concat(F.lit("R"), F.col("k").cast("string")).alias("rule_name"),
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(_graph_rows(spark, sf_dir))


EDGE = "src_uid, dst_uid, rtype, event_id, ts_us, is_alarm, tactic_id, technique_id, severity"


@query(duck(f"{_GRAPH_SQL} SELECT {EDGE} FROM edges"))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select(*EDGE.split(", "))


@query(duck(f"""{_GRAPH_SQL}, named AS (SELECT h AS uid, host_name AS name, ts_us FROM g UNION ALL SELECT u, user_name, ts_us FROM g UNION ALL SELECT p, process_name, ts_us FROM g UNION ALL SELECT f, '/f/' || k, ts_us FROM g UNION ALL
  SELECT i, dst_ip, ts_us FROM g UNION ALL SELECT d, dst_domain, ts_us FROM g UNION ALL SELECT src_uid, NULL, ts_us FROM edges UNION ALL SELECT dst_uid, NULL, ts_us FROM edges)
SELECT uid, split_part(uid, ':', 1) AS ntype, max(ts_us) AS ts_us, max(name) AS name FROM named WHERE uid IS NOT NULL GROUP BY uid"""))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_graph_rows(spark, sf_dir)).select("uid", "ntype", "ts_us", "name")


@query(duck("""x AS (SELECT 'Host:host.id=' || host_id AS uid, n, action AS last_action, CASE WHEN k % 3 = 0 THEN dst_ip END AS last_ip FROM ecs)
SELECT uid, arg_max(last_action, n) AS last_action, arg_max(last_ip, CASE WHEN last_ip IS NOT NULL THEN n END) AS last_ip FROM x GROUP BY uid"""))
def node_upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of hosts, in two writes; absent ones keep their last value."""
    e = ecs(spark, sf_dir)
    ip = F.when((F.col("k") % 3 == 0) & F.col("dst_ip").isNotNull(), F.create_map(F.lit("last_ip"), "dst_ip")).otherwise(F.create_map().cast("map<string,string>"))
    rows = e.select(F.concat(F.lit("Host:host.id="), "host_id").alias("uid"), F.map_concat(F.create_map(F.lit("last_action"), "action"), ip).alias("props"), F.col("n").alias("ord"))
    stored = graph.merge_nodes(rows.where("n < 1000"))
    return graph.merge_nodes(rows.where("n >= 1000"), stored).select("uid", F.col("props")["last_action"].alias("last_action"), F.col("props")["last_ip"].alias("last_ip"))


@query(duck(f"""{_GRAPH_SQL}, k AS (SELECT src_uid, dst_uid, rtype, 'b-' || (ts_us // 3600000000) AS event_id, ts_us, severity FROM edges) SELECT src_uid, dst_uid, rtype, event_id, max(ts_us) AS ts_us, arg_max(severity, ts_us) AS severity FROM k GROUP BY 1, 2, 3, 4"""))
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edges(spark, sf_dir).select("src_uid", "dst_uid", "rtype", F.concat(F.lit("b-"), F.floor(F.col("ts_us") / 3600000000).cast("string")).alias("event_id"), "ts_us", "severity")
    return graph.merge_edges(rows)


@query(duck(f"""{_GRAPH_SQL} SELECT src_uid, dst_uid, rtype, event_id, kind, ds AS dataset, action, CASE WHEN rtype = 'FILE_ACCESS' THEN action END AS op, CASE WHEN is_alarm THEN round(confidence, 6) END AS confidence,
  CASE WHEN is_alarm THEN provider END AS providers, CASE WHEN is_alarm THEN 'R' || k END AS rule_name, CASE WHEN is_alarm THEN event_id END AS evidence_ids FROM edges"""))
def edge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edges take over from their events, and from alerts alone."""
    return _edges(spark, sf_dir).select(*graph.EDGE_KEY, "kind", "dataset", "action", "op", r6("confidence"), listed("providers"), "rule_name", listed("evidence_ids"))


@query(duck("""x AS (SELECT event_id, host_id, k, action, ts_us, CASE WHEN k % 4 = 0 THEN process_entity_id WHEN k % 4 = 1 THEN 'p-' || substr(sha1(host_id || ':' || k || ':' || ts_us || ':/bin/' || action), 1, 16) END AS p FROM ecs)
SELECT event_id, 'Process:process.entity_id=' || p AS src_uid, CASE k % 5 WHEN 0 THEN 'write' WHEN 1 THEN 'read' WHEN 2 THEN 'execute' WHEN 3 THEN 'raw' END AS op FROM x WHERE p IS NOT NULL"""))
def file_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File accesses (with made-up actions) by processes with a given id, and with one made of host, pid, time and executable."""
    c = F.col
    action = F.element_at(F.array(*map(F.lit, ["file_modify", "Open", "file_execute", "raw", None])), (c("k") % 5 + 1).cast("int"))
    rows = ecs(spark, sf_dir).select(
        "event_id", "ts_us", F.lit("event").alias("kind"), F.lit("hostbehavior.file").alias("dataset"), action.alias("action"), "host_id", "host_name", "user_id", "user_name", "process_entity_id", "process_name", "dst_ip",
        F.when(c("k") % 4 == 1, c("k")).alias("pid"), F.concat(F.lit("/bin/"), c("action")).alias("executable"), F.lit("/etc/x").alias("file_path"), F.array().cast("array<string>").alias("evidence_ids"), "tactic_id", "technique_id", "severity",
    )
    return graph.edges(rows).where("rtype = 'FILE_ACCESS'").select("event_id", "src_uid", "op")


@query(duck(f"""{_GRAPH_SQL}, m AS (SELECT DISTINCT src_uid AS a, dst_uid AS b, CASE rtype WHEN 'NET_CONNECT' THEN 1.0 WHEN 'LOGON' THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM edges WHERE rtype <> 'RUNS_ON'),
l AS (SELECT a, b, min(w) AS w FROM m GROUP BY a, b), s0 AS (SELECT min(src_uid) AS uid FROM edges WHERE rtype = 'LOGON'), p1 AS (SELECT uid, 0.0::DOUBLE AS c FROM s0),
p2 AS (SELECT b AS uid, c + w AS c FROM p1 JOIN l ON a = uid), p3 AS (SELECT b AS uid, c + w AS c FROM p2 JOIN l ON a = uid), p4 AS (SELECT b AS uid, c + w AS c FROM p3 JOIN l ON a = uid), p5 AS (SELECT b AS uid, c + w AS c FROM p4 JOIN l ON a = uid),
o AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5) SELECT uid, round(min(c), 6) AS cost FROM o GROUP BY uid"""))
def event_graph_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs over the events' whole graph from the first user; no edge leaves addresses, so that paths end by themselves."""
    found = _edges(spark, sf_dir).where("rtype <> 'RUNS_ON'")
    source = found.where("rtype = 'LOGON'").agg(F.min("src_uid").alias("uid")).first()["uid"]
    return graph.shortest_costs(found, source, {"LOGON": 0.5}).select("uid", r6("cost"))


@query(duck("""x AS (SELECT *, 'Host:host.id=' || host_id AS h, 'User:user.id=' || user_id AS u, 'Process:process.entity_id=' || process_entity_id AS p, 'Process:process.entity_id=parent-' || (k % 9) AS q FROM ecs),
v AS (SELECT h AS uid, 'host.id' AS k, host_id AS v, ts_us FROM x UNION ALL SELECT h, 'host.name', host_name, ts_us FROM x UNION ALL SELECT u, 'user.id', user_id::VARCHAR, ts_us FROM x UNION ALL SELECT u, 'user.name', user_name, ts_us FROM x UNION ALL SELECT u, 'host.id', host_id, ts_us FROM x
  UNION ALL SELECT p, 'process.name', process_name, ts_us FROM x UNION ALL SELECT p, 'host.id', host_id, ts_us FROM x UNION ALL SELECT p, 'process.command_line', CASE WHEN k % 3 = 0 THEN action || ' -' || k END, ts_us FROM x
  UNION ALL SELECT q, 'process.name', 'init', ts_us FROM x WHERE k % 2 = 0 UNION ALL SELECT q, 'host.id', host_id, ts_us FROM x WHERE k % 2 = 0 UNION ALL SELECT 'IP:ip=' || dst_ip, 'ip', dst_ip, ts_us FROM x UNION ALL SELECT 'Domain:domain.name=' || dst_domain, 'domain.name', dst_domain, ts_us FROM x)
SELECT uid, k AS property, arg_max(v, (ts_us, v)) AS value FROM v WHERE uid IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2"""))
def node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of hosts, users, processes, their parents, addresses and domains, each as it was last told."""
    rows = ecs(spark, sf_dir).withColumns({
        "kind": F.lit("event"), "evidence_ids": F.array("event_id"), "parent_entity_id": F.when(F.col("k") % 2 == 0, F.concat(F.lit("parent-"), (F.col("k") % 9).cast("string"))), "parent_name": F.lit("init"),
        "command_line": F.when(F.col("k") % 3 == 0, F.concat("action", F.lit(" -"), F.col("k").cast("string"))), "file_path": F.lit(None).cast("string"),
    })
    return graph.node_properties(rows).select("uid", F.explode(F.map_entries("props")).alias("e")).select("uid", F.col("e.key").alias("property"), F.col("e.value").alias("value"))


@query(duck("""x AS (SELECT *, 'Process:process.entity_id=' || process_entity_id AS p FROM ecs WHERE action = 'click' AND process_entity_id IS NOT NULL)
SELECT 'Process:process.entity_id=parent-' || (k % 9) AS src_uid, p AS dst_uid, 'SPAWN' AS rtype, event_id, 'start,' || action AS event_type, 'c' || k AS event_code, NULL AS ruleset FROM x UNION ALL
SELECT p, 'Host:host.id=' || host_id, 'RUNS_ON', event_id, 'start,' || action, 'c' || k, NULL FROM x"""))
def spawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes with parents: what spawned them and where they run, with the event's types and code."""
    k = F.col("k").cast("string")
    rows = ecs(spark, sf_dir).where("action = 'click' AND process_entity_id IS NOT NULL").withColumns({
        "kind": F.lit("event"), "dataset": F.lit("hostlog.process"), "evidence_ids": F.array("event_id"), "parent_entity_id": F.concat(F.lit("parent-"), (F.col("k") % 9).cast("string")),
        "event_type": F.array(F.lit("start"), F.col("action")), "event_code": F.concat(F.lit("c"), k), "ruleset": F.lit("for alerts alone"),
    })
    return graph.edges(rows).select(*graph.EDGE_KEY, listed("event_type"), "event_code", "ruleset")


@query(duck(f"{_GRAPH_SQL} SELECT {EDGE} FROM edges WHERE is_alarm"))
def alarm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.alarms(_edges(spark, sf_dir)).select(*EDGE.split(", "))


@query(duck(f"{_GRAPH_SQL} SELECT {EDGE} FROM edges WHERE ts_us BETWEEN 1704500000000000 AND 1705000000000000 AND rtype IN ('NET_CONNECT', 'DNS_QUERY')"))
def edges_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_window(_edges(spark, sf_dir), 1704500000.0, 1705000000.0, ["NET_CONNECT", "DNS_QUERY"]).select(*EDGE.split(", "))


@query(duck(f"{_GRAPH_SQL} SELECT {EDGE} FROM edges WHERE technique_id = 'T1041' OR tactic_id = 'T1041'"))
def edges_by_attack_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_attack_id(_edges(spark, sf_dir), "T1041").select(*EDGE.split(", "))


@query(duck(f"{_GRAPH_SQL}, a AS (SELECT * FROM edges WHERE is_alarm), e AS (SELECT src_uid AS uid FROM a UNION SELECT dst_uid FROM a) SELECT uid, split_part(uid, ':', 1) AS ntype FROM e"))
def edge_endpoints_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graph_rows(spark, sf_dir)
    return graph.nodes_of(graph.nodes(rows), graph.alarms(graph.edges(rows))).select("uid", "ntype")


@query(duck(f"{_GRAPH_SQL} SELECT {EDGE} FROM edges WHERE src_uid = 'IP:ip=10.0.0.5' OR dst_uid = 'IP:ip=10.0.0.5'"))
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incident(_edges(spark, sf_dir), "IP:ip=10.0.0.5").select(*EDGE.split(", "))


@query(duck(f"{_GRAPH_SQL} SELECT arg_min(src_uid, (ts_us, event_id)) AS host_uid FROM edges WHERE dst_uid = 'IP:ip=10.0.0.5' AND src_uid LIKE 'Host:%'"))
def infer_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.infer_host(_edges(spark, sf_dir), "IP:ip=10.0.0.5")


@query(duck(f"{_GRAPH_SQL} SELECT src_uid, rtype, dst_uid, count(*) AS n_edges, min(ts_us) AS first_us, max(ts_us) AS last_us FROM edges GROUP BY 1, 2, 3"))
def parallel_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parallel_counts(_edges(spark, sf_dir))


@query(duck(f"{_GRAPH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY src_uid, dst_uid, rtype, event_id) AS rn FROM edges) SELECT src_uid, dst_uid, rtype, event_id, CASE WHEN is_alarm THEN 'trace-1' END AS task_id, CASE WHEN is_alarm THEN severity END AS risk FROM k"))
def edge_analysis_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _edges(spark, sf_dir).withColumn("task_id", F.lit("old")).withColumn("risk", F.lit(0))
    results = graph.alarms(found).select(*graph.EDGE_KEY, F.lit("trace-1").alias("task_id"), F.col("severity").alias("risk")).distinct()
    return graph.write_analysis(found, results, ["task_id", "risk"]).select(*graph.EDGE_KEY, "task_id", "risk")


_NATION = "steps AS (SELECT DISTINCT 'N' || c_nationkey AS a, 'N' || ((c_nationkey * 7 + c_custkey % 3) % 25) AS b, CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS w FROM customer)"


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = lambda x: F.concat(F.lit("N"), x.cast("string"))
    return c.select(name(F.col("c_nationkey")).alias("src_uid"), name((F.col("c_nationkey") * 7 + F.col("c_custkey") % 3) % 25).alias("dst_uid"), F.when(F.col("c_custkey") % 3 == 0, "SPAWN").otherwise("LOGON").alias("rtype"), F.col("c_custkey").cast("string").alias("event_id"), F.lit(0.0).alias("ts_float"))


@query(f"""WITH RECURSIVE {_NATION}, m AS (SELECT a, b, min(w) AS w FROM steps GROUP BY a, b), walk(uid, cost, hops) AS (SELECT 'N0', 0.0::DOUBLE, 0 UNION SELECT m.b, walk.cost + m.w, hops + 1 FROM walk JOIN m ON m.a = walk.uid WHERE hops < 25)
SELECT uid, round(min(cost), 6) AS cost FROM walk GROUP BY uid""")
def shortest_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs from one node: 1.0 for the riskiest type and 1.5 for the other."""
    out = graph.shortest_costs(_nation_edges(spark, sf_dir), "N0", {"SPAWN": 1.0, "LOGON": 0.5})
    return out.select("uid", r6("cost"))


_HOPS = """p AS (SELECT src_uid AS a, dst_uid AS b, event_id, ts_us FROM edges WHERE ts_us BETWEEN 1704100000000000 AND 1704130000000000 AND rtype <> 'HAS_IP'), e AS (SELECT a, b, event_id, ts_us FROM p UNION ALL SELECT b, a, event_id, ts_us FROM p),
w AS (SELECT a AS src_uid, b AS e1, NULL AS e2, NULL AS e3, [a, b] AS path, [event_id] AS steps, ts_us AS t FROM e WHERE a LIKE 'User:%'),
w2 AS (SELECT w.src_uid, e.b, list_append(path, e.b) AS path, list_append(steps, e.event_id) AS steps, e.ts_us AS t FROM w JOIN e ON e.a = w.e1 WHERE e.ts_us >= w.t AND NOT list_contains(path, e.b)),
w3 AS (SELECT w2.src_uid, e.b, list_append(path, e.b) AS path, list_append(steps, e.event_id) AS steps, e.ts_us AS t FROM w2 JOIN e ON e.a = w2.b WHERE e.ts_us >= w2.t AND NOT list_contains(path, e.b)),
o AS (SELECT src_uid, path, steps FROM w UNION ALL SELECT src_uid, path, steps FROM w2 UNION ALL SELECT src_uid, path, steps FROM w3)"""


@query(duck(f"{_GRAPH_SQL}, {_HOPS} SELECT src_uid, path[-1] AS dst_uid, len(steps)::INT AS hops, array_to_string(path, '>') AS path, array_to_string(steps, ',') AS steps FROM o"))
def k_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of up to three hops in time order from the users, within a window of some hours."""
    found = _edges(spark, sf_dir).where("rtype <> 'HAS_IP'")
    window = graph.in_window(found, 1704100000.0, 1704130000.0)
    sources = graph.endpoints(window).where("uid LIKE 'User:%'")
    return graph.temporal_paths(found, sources, 3, 1704100000.0, 1704130000.0, texts=True)


_BACK = """p AS (SELECT src_uid AS a, dst_uid AS b, ts_us / 1e6 AS t FROM edges WHERE ts_us BETWEEN 1704100000000000 AND 1704400000000000 AND rtype <> 'HAS_IP' AND src_uid <> dst_uid),
e AS (SELECT a, b, t FROM p UNION ALL SELECT b, a, t FROM p), r0 AS (SELECT DISTINCT b AS g, b AS node, 1704400000.0::DOUBLE AS dep FROM e WHERE b LIKE 'Domain:%'),
n1 AS (SELECT g, e.a AS node, max(t) AS dep FROM r0 JOIN e ON e.b = r0.node WHERE t <= dep GROUP BY 1, 2), k1 AS (SELECT g, node, dep FROM r0), r1 AS (SELECT n1.* FROM n1 LEFT JOIN k1 USING (g, node) WHERE k1.dep IS NULL OR n1.dep > k1.dep),
n2 AS (SELECT g, e.a AS node, max(t) AS dep FROM r1 JOIN e ON e.b = r1.node WHERE t <= dep GROUP BY 1, 2), k2 AS (SELECT g, node, max(dep) AS dep FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1) GROUP BY 1, 2), r2 AS (SELECT n2.* FROM n2 LEFT JOIN k2 USING (g, node) WHERE k2.dep IS NULL OR n2.dep > k2.dep),
n3 AS (SELECT g, e.a AS node, max(t) AS dep FROM r2 JOIN e ON e.b = r2.node WHERE t <= dep GROUP BY 1, 2), k3 AS (SELECT g, node, max(dep) AS dep FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2), r3 AS (SELECT n3.* FROM n3 LEFT JOIN k3 USING (g, node) WHERE k3.dep IS NULL OR n3.dep > k3.dep),
o AS (SELECT g, node, 0 AS hops, dep FROM r0 UNION ALL SELECT g, node, 1, dep FROM r1 UNION ALL SELECT g, node, 2, dep FROM r2 UNION ALL SELECT g, node, 3, dep FROM r3)"""


@query(duck(f"{_GRAPH_SQL}, {_BACK} SELECT g AS dst_uid, node AS uid, hops, round(dep, 6) AS departs FROM o"))
def reverse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where the domains of some days can be reached in three hops in time order, and how late one may leave."""
    found = _edges(spark, sf_dir).where("rtype <> 'HAS_IP'")
    targets = graph.endpoints(graph.in_window(found, 1704100000.0, 1704400000.0)).where("uid LIKE 'Domain:%'")
    return graph.reverse_paths(found, targets, 3, 1704100000.0, 1704400000.0).select("dst_uid", "uid", "hops", r6("departs"))


# --- search and reports


@query(duck("x AS (SELECT 1) SELECT event_id, ts_us, host_name, dataset FROM ecs WHERE ts_us BETWEEN 1704500000000000 AND 1705000000000000 AND (dataset LIKE 'netflow.%' OR dataset = 'hostlog.auth') ORDER BY ts_us DESC, event_id OFFSET 10 LIMIT 50"))
def events_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = reports.events_condition(1704500000000000, 1705000000000000, datasets=["netflow.*", "hostlog.auth"])
    return reports.search(ecs(spark, sf_dir), condition, [F.col("ts_us").desc(), F.col("event_id")], 10, 50).select("event_id", "ts_us", "host_name", "dataset")


@query(duck(CANONICAL.format(key=KEY.format(m=1440))) + "SELECT event_id, tactic_id, severity FROM c WHERE tactic_id IN ('TA0004', 'TA0010') AND severity >= 70 AND list_contains(string_split(providers, ','), 'falco')")
def findings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.canonical(_alerts(spark, sf_dir), 1440)
    return found.where(reports.findings_condition(["TA0004", "TA0010"], providers=["falco"], least_severity=70)).select("event_id", "tactic_id", "severity")


@query(duck("x AS (SELECT 1) SELECT event_id, ts_us FROM ecs WHERE host_id = 'h-' || substr(sha1('host-3'), 1, 16) AND ts_us BETWEEN 1704500000000000 AND 1705000000000000 ORDER BY ts_us, event_id LIMIT 200"))
def events_of_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = reports.events_condition(1704500000000000, 1705000000000000, host_id="h-" + hashlib.sha1(b"host-3").hexdigest()[:16])
    return reports.search(ecs(spark, sf_dir), condition, [F.col("ts_us"), F.col("event_id")], 0, 200).select("event_id", "ts_us")


@query(duck("x AS (SELECT *, 'R' || k AS rule_name, 'rule-' || substr(sha1('R' || k), 1, 16) AS rule_id FROM ecs WHERE kind = 'alert') SELECT event_id, rule_id FROM x WHERE rule_name IN ('R5', 'R50') OR rule_id = 'rule-' || substr(sha1('R17'), 1, 16)"))
def findings_of_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alerts(spark, sf_dir).withColumn("rule_name", F.concat(F.lit("R"), F.col("k").cast("string")))
    rows = rows.withColumn("rule_id", ids.rule_id(F.lit(None).cast("string"), F.col("rule_name")))
    return rows.where(reports.findings_condition(rules=["R5", "R50", "rule-" + hashlib.sha1(b"R17").hexdigest()[:16]])).select("event_id", "rule_id")


@query("SELECT o_orderkey AS task_id, o_orderstatus AS status, epoch_us(o_orderdate) AS created_us FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 10 = 3 ORDER BY created_us DESC, task_id LIMIT 20")
def tasks_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand in for analysis tasks: status, target and newest first."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"), (F.col("o_custkey") % 10).alias("target"))
    return reports.search(t, reports.filter_of({"bool": {"must": [{"term": {"status": "F"}}, {"term": {"target": 3}}]}}), [F.col("created_us").desc(), F.col("task_id")], 0, 20).drop("target")


@query(duck("x AS (SELECT 1) SELECT event_id FROM ecs WHERE kind = 'alert' AND severity >= 60 AND NOT coalesce(dst_domain = 'd3.example', false) AND ((technique_id IN ('T1041', 'T1059'))::INT + (host_name = 'host-3')::INT + (process_entity_id IS NOT NULL)::INT >= 2)"))
def dsl_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"bool": {
        "must": [{"term": {"kind": "alert"}}], "filter": [{"range": {"severity": {"gte": 60}}}], "must_not": [{"term": {"dst_domain": "d3.example"}}],
        "should": [{"terms": {"technique_id": ["T1041", "T1059"]}}, {"wildcard": {"host_name": "host-3"}}, {"exists": {"field": "process_entity_id"}}], "minimum_should_match": 2,
    }}
    return ecs(spark, sf_dir).where(reports.filter_of(q)).select("event_id")


@query(duck("x AS (SELECT 1) SELECT CASE tactic_id WHEN 'TA0008' THEN 'lateral' WHEN 'TA0004' THEN 'privilege' WHEN 'TA0010' THEN 'exfiltration' WHEN 'TA0001' THEN 'login' WHEN 'TA0006' THEN 'login' ELSE 'other' END AS category, count(*) AS n FROM ecs WHERE kind = 'alert' GROUP BY 1"))
def overview_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).groupBy(detect.overview_category(F.col("tactic_id"), attack.tactic_name_of_id(F.col("tactic_id"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(duck("x AS (SELECT 1) SELECT dataset, count(*) AS n FROM ecs GROUP BY dataset ORDER BY n DESC, dataset LIMIT 10"))
def terms_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.terms(ecs(spark, sf_dir), "dataset", 10)


_LEVEL = "CASE WHEN k % 4 = 0 AND k % 8 = 0 THEN 2 WHEN k % 4 = 0 THEN 1 ELSE 0 END"


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.when(F.col("k") % 4 == 0, F.lit("/usr/bin/SUDO -i")).otherwise(F.lit("ls"))
    parent = F.when(F.col("k") % 8 == 0, F.lit("Firefox")).otherwise(F.lit("bash"))
    out = ecs(spark, sf_dir).withColumn("level", correlate.privilege_level(F.col("process_name"), command, parent))
    return out.withColumn("level_confidence", correlate.level_confidence(F.col("level")))


@query(duck(f"x AS (SELECT event_id, {_LEVEL} AS level FROM ecs) SELECT event_id, level, CASE level WHEN 2 THEN 0.6 WHEN 1 THEN 0.4 ELSE 0.0 END::DOUBLE AS level_confidence FROM x"))
def privilege_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leveled(spark, sf_dir).select("event_id", "level", "level_confidence")


RULES = [
    detect.MessageRule("click seen", "low", contains=("CLICK",), tags=("attack.t1059",)), detect.MessageRule("error twice", "critical", contains_all=(("error", "user-1"),)),
    detect.MessageRule("an alert", "medium", equals={"kind": ("alert",)}), detect.MessageRule("data out", "high", contains=("purchase",), contains_all=(("view", "host-7"),)),
]


@query(duck("""m AS (SELECT event_id, kind, action || ' by ' || user_name || ' on ' || host_name AS s FROM ecs),
h AS (SELECT event_id, list_filter([CASE WHEN kind = 'alert' THEN 'an alert' END, CASE WHEN contains(s, 'click') THEN 'click seen' END, CASE WHEN contains(s, 'purchase') OR (contains(s, 'view') AND contains(s, 'host-7')) THEN 'data out' END,
  CASE WHEN contains(s, 'error') AND contains(s, 'user-1') THEN 'error twice' END], lambda x: x IS NOT NULL) AS l FROM m)
SELECT event_id, array_to_string(l, ',') AS matched_rules, l[1] AS rule_name, CASE l[1] WHEN 'an alert' THEN 50 WHEN 'click seen' THEN 30 WHEN 'data out' THEN 70 WHEN 'error twice' THEN 90 END AS rule_severity FROM h WHERE len(l) > 0"""))
def sigma_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat_ws(" ", F.col("action"), F.lit("by"), F.col("user_name"), F.lit("on"), F.col("host_name"))
    out = detect.matched(ecs(spark, sf_dir).withColumn("message", message), RULES)
    return out.where(F.size("matched_rules") > 0).select("event_id", listed("matched_rules"), "rule_name", "rule_severity")


@query(duck("x AS (SELECT host_name, ts_us // 86400000000 AS slot, ts_us FROM ecs WHERE action = 'error') SELECT host_name, slot, count(*) AS n_events, min(ts_us) AS first_us, max(ts_us) AS last_us FROM x GROUP BY 1, 2 HAVING count(*) > 5"))
def failed_login_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.bursts(ecs(spark, sf_dir).where("action = 'error'"), ["host_name"], minutes=1440, over=5)


_ENTROPY = """c AS (SELECT n, s, unnest(string_split(s, '')) AS ch FROM w), f AS (SELECT n, s, ch, count(*) AS m FROM c GROUP BY 1, 2, 3),
e AS (SELECT n, s, -sum(m::DOUBLE / length(s) * log2(m::DOUBLE / length(s))) AS h FROM f GROUP BY 1, 2)"""


@query(f"""WITH w AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 5 = 0 THEN repeat('a', 60 + (c_custkey % 3)::INT) ELSE substr(sha1(c_name), 1, 8 + (c_custkey % 30)::INT) END AS s FROM customer), {_ENTROPY}
SELECT n, s AS dst_domain, length(s)::INT AS name_length, round(h, 3) AS name_entropy FROM e WHERE length(s) >= 60 OR h >= 3.3""")
def dns_entropy_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.expr("repeat('a', cast(60 + c_custkey % 3 AS INT))")).otherwise(F.expr("substr(sha1(c_name), 1, cast(8 + c_custkey % 30 AS INT))"))
    out = detect.dns_tunnels(c.select(k.alias("n"), name.alias("dst_domain")), most_entropy=3.3)
    return out.where((F.col("name_length") >= 60) | (texts.entropy(F.col("dst_domain")) >= 3.3)).withColumn("name_entropy", F.col("name_entropy") + F.lit(0.0))


def _eve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ecs(spark, sf_dir)
    c = F.col
    base = [F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX").alias("timestamp"), c("host_ip").alias("src_ip"), c("dst_ip").alias("dest_ip"), (c("k") + F.when(c("k") == 7, F.lit(8881)).otherwise(F.lit(1000))).alias("src_port"), c("n").alias("flow_id"), F.lit("TCP").alias("proto")]
    flow = F.struct(F.lit("flow").alias("event_type"), *base, F.struct(c("k").alias("bytes_toserver"), (c("k") * 2).alias("bytes_toclient"), F.when(c("k") % 2 == 0, "2024-01-01").alias("end")).alias("flow"))
    alert = F.struct(F.lit("alert").alias("event_type"), *base, F.struct(c("n").alias("signature_id"), F.lit("sig").alias("signature"), (c("k") % 8 + 1).alias("severity"), F.create_map(F.lit("mitre_technique_id"), F.array("technique_id")).alias("metadata")).alias("alert"))
    dns = F.struct(F.lit("dns").alias("event_type"), *base, F.struct(F.concat(F.sha1("event_id"), F.lit("."), F.when(c("k") % 10 == 0, F.md5("event_id")).otherwise(F.lit("x"))).alias("rrname"), F.lit("A").alias("rrtype")).alias("dns"))
    kind = c("n") % 3
    return e.select(F.when(kind == 0, F.to_json(flow)).when(kind == 1, F.to_json(alert)).otherwise(F.to_json(dns)).alias("value"))


@query(duck("""x AS (SELECT *, n % 3 AS t, sha1(event_id) || '.' || CASE WHEN k % 10 = 0 THEN md5(event_id) ELSE 'x' END AS q FROM ecs WHERE k <> 7)
SELECT flow_id, dataset, kind, action, risk_score, technique_id, network_bytes FROM (
 SELECT n::VARCHAR AS flow_id, 'netflow.flow' AS dataset, 'event' AS kind, CASE WHEN k % 2 = 0 THEN 'flow_end' ELSE 'flow_start' END AS action, NULL::INT AS risk_score, NULL AS technique_id, nullif(k * 3, 0)::BIGINT AS network_bytes FROM x WHERE t = 0 UNION ALL
 SELECT n::VARCHAR, 'finding.raw.suricata', 'alert', 'suricata_alert', greatest(0, 100 - (k % 8) * 20), technique_id, NULL FROM x WHERE t = 1 UNION ALL
 SELECT n::VARCHAR, 'netflow.dns', 'event', 'dns_query', NULL, NULL, NULL FROM x WHERE t = 2 UNION ALL
 SELECT n::VARCHAR, 'finding.raw.suricata', 'alert', 'dns_tunnel_suspected', 60, 'T1071.004', NULL FROM x WHERE t = 2 AND length(q) >= 60)
"""))
def suricata_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network sensor lines mapped; names here have an entropy of under 4 bits, so that length decides."""
    out = sensors.eve(_eve_lines(spark, sf_dir))
    out = out.where(~((F.col("action") == "dns_tunnel_suspected") & (F.length("dst_domain") < 60)))
    return out.select("flow_id", "dataset", "kind", "action", "risk_score", "technique_id", "network_bytes")


@query(duck("""x AS (SELECT 1) SELECT event_id, CASE WHEN k % 3 = 0 THEN host_ip END AS src_ip, CASE WHEN k % 3 = 0 THEN k END AS src_port, CASE k % 3 WHEN 0 THEN '10.1.1.1' WHEN 1 THEN host_ip WHEN 2 THEN '2001:db8::' || (k % 10) END AS dst_ip, CASE k % 3 WHEN 0 THEN 443 WHEN 1 THEN k ELSE 53 END AS dst_port FROM ecs"""))
def falco_fd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    fd = F.when(F.col("k") % 3 == 0, F.concat("host_ip", F.lit(":"), k, F.lit("->10.1.1.1:443"))).when(F.col("k") % 3 == 1, F.concat("host_ip", F.lit(":"), k)).otherwise(F.concat(F.lit("[2001:db8::"), (F.col("k") % 10).cast("string"), F.lit("]:53")))
    return ecs(spark, sf_dir).select("event_id", sensors.fd_endpoints(fd).alias("e")).select("event_id", "e.*")


@query(duck("""x AS (SELECT *, k % 4 AS t FROM ecs) SELECT event_id, CASE WHEN t < 3 THEN user_name END AS user_name, CASE WHEN t < 3 THEN host_ip END AS source_ip, CASE WHEN t < 2 THEN 'user_login' WHEN t = 2 THEN 'user_logout' END AS action,
  CASE WHEN t = 1 THEN 'failure' WHEN t < 3 THEN 'success' END AS outcome FROM x"""))
def authlog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("k") % 4
    said = (
        F.when(t == 0, F.concat(F.lit("sshd[12]: Accepted password for "), "user_name", F.lit(" from "), "host_ip", F.lit(" port 22"))).when(t == 1, F.concat(F.lit("sshd[9]: Failed password for invalid user "), "user_name", F.lit(" from "), "host_ip"))
        .when(t == 2, F.concat(F.lit("sshd[3]: Disconnected from user "), "user_name", F.lit(" "), "host_ip")).otherwise(F.lit("cron[1]: job"))
    )
    return ecs(spark, sf_dir).select("event_id", sensors.auth(said).alias("a")).select("event_id", "a.*")


# --- correlation

_COR = f"l AS (SELECT *, {_LEVEL} AS level, CASE WHEN k % 8 = 0 THEN 0.6 WHEN k % 4 = 0 THEN 0.4 ELSE 0.0 END::DOUBLE AS lc, '10.0.0.' || (k % 10) AS dip, CASE WHEN k % 6 <> 0 THEN 'u' || (user_id % 5) END AS un, CASE WHEN k % 7 <> 0 THEN host_ip END AS hip FROM ecs)"


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leveled(spark, sf_dir).select("n", "event_id", "ts_us", "host_name", "host_id", F.when(F.col("k") % 6 != 0, F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))).alias("user_name"), F.when(F.col("k") % 7 != 0, F.col("host_ip")).alias("host_ip"), F.col("host_ip").alias("src_ip"), F.concat(F.lit("10.0.0."), (F.col("k") % 10).cast("string")).alias("dst_ip"), "level", "level_confidence", "action")


@query(duck(_COR + """, a AS (SELECT * FROM l WHERE action = 'signup'), b AS (SELECT * FROM l WHERE action = 'error'),
p AS (SELECT DISTINCT a.event_id AS id1, b.event_id AS id2, a.ts_us, greatest(a.lc, b.lc) AS top FROM a JOIN b ON (a.dip = b.host_ip OR a.host_ip = b.dip) AND a.host_name <> b.host_name AND abs(a.ts_us - b.ts_us) <= 21600000000)
SELECT id1, id2, ts_us, round(CASE WHEN top > 0 THEN least(1.0, 0.8 + 0.2 * top) ELSE 0.8 END, 6)::DOUBLE AS score, 'corr-' || substr(md5(id1 || '-' || id2), 1, 16) AS correlation_id FROM p"""))
def corr_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs."""
    e = _correlated(spark, sf_dir)
    return correlate.two_stage_all(e.where("action = 'signup'"), e.where("action = 'error'"), 6 * 3600 * 1000000).withColumn("score", F.round("score", 6))


@query(duck(_COR + """, a AS (SELECT * FROM l WHERE action = 'signup'), b AS (SELECT * FROM l WHERE action = 'error'),
p AS (SELECT DISTINCT a.event_id AS id1, b.event_id AS id2, a.ts_us, b.ts_us AS t2, greatest(a.lc, b.lc) AS top FROM a JOIN b ON (a.dip = b.host_ip OR a.host_ip = b.dip) AND a.host_name <> b.host_name AND abs(a.ts_us - b.ts_us) <= 86400000000),
g AS (SELECT id1, any_value(ts_us) AS ts_us, count(*) AS n_links, arg_min(id2, (-t2, id2)) AS id2, arg_min(top, (-t2, id2)) AS top FROM p GROUP BY id1)
SELECT id1, ts_us, n_links, id2, round(CASE WHEN top > 0 THEN least(1.0, 0.8 + 0.2 * top) ELSE 0.8 END, 6)::DOUBLE AS score FROM g"""))
def corr_two_stage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event the number of its links within a day, and its latest partner; no pair is made."""
    e = _correlated(spark, sf_dir)
    links, _ = correlate.two_stage(e.where("action = 'signup'"), e.where("action = 'error'"))
    return links.select("id1", "ts_us", "n_links", "id2", r6("score"))


_THREE = _COR + """, q1 AS (SELECT * FROM l WHERE action = 'signup'), q2 AS (SELECT * FROM l WHERE action = 'click'), q3 AS (SELECT * FROM l WHERE action = 'error'),
m1 AS (SELECT q2.*, q1.event_id AS id1, q1.ts_us AS ts1, q1.lc AS lc1, row_number() OVER (PARTITION BY q2.event_id ORDER BY q1.ts_us DESC, q1.event_id) AS rn FROM q2 JOIN q1 ON q1.host_name = q2.host_name AND coalesce(q1.un = q2.un, true) AND q1.ts_us <= q2.ts_us),
m2 AS (SELECT m1.event_id AS id2, id1, ts1, lc1, m1.lc AS lc2, m1.host_name AS h2, q3.event_id AS id3, q3.lc AS lc3, q3.host_name AS h3, row_number() OVER (PARTITION BY m1.event_id ORDER BY q3.ts_us, q3.event_id) AS rn FROM m1 JOIN q3 ON coalesce(q3.hip = m1.dip, true) AND coalesce(q3.un = m1.un, true) AND q3.host_name <> m1.host_name AND q3.ts_us >= m1.ts_us WHERE m1.rn = 1),
m3 AS (SELECT *, greatest(lc1, lc2, lc3) AS top FROM m2 WHERE rn = 1),
c3 AS (SELECT 'corr-' || substr(md5(id1 || '-' || id2 || '-' || id3), 1, 16) AS correlation_id, id1, id2, id3, ts1 AS ts_us, CASE WHEN top > 0 THEN least(1.0, 0.9 + 0.1 * top) ELSE 0.9 END AS score FROM m3)"""


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _correlated(spark, sf_dir)
    return correlate.three_stage(*[e.where(F.col("action") == a) for a in ("signup", "click", "error")]), e


@query(duck(_THREE + " SELECT correlation_id, id1, id2, id3, ts_us, round(score, 6)::DOUBLE AS score FROM c3"))
def corr_nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query(duck(_THREE + """, m AS (SELECT DISTINCT correlation_id, unnest([id1, id2, id3]) AS event_id FROM c3), j AS (SELECT m.correlation_id, l.* FROM m JOIN l USING (event_id)),
g AS (SELECT correlation_id, count(*) AS n_events, count(DISTINCT host_id) AS n_hosts, max(level) AS max_level, avg(level) AS al, max(lc) AS top, min(ts_us) AS first_us, max(ts_us) AS last_us FROM j GROUP BY 1)
SELECT correlation_id, n_events, n_hosts, max_level, first_us, last_us, round(least(1.0, least(0.5 + 0.1 * n_events, 1.0) + CASE WHEN max_level >= 2 THEN 0.1 WHEN max_level >= 1 THEN 0.1 * top ELSE 0 END), 6)::DOUBLE AS confidence,
  CASE WHEN al >= 3 THEN 80 WHEN al >= 2 THEN 70 WHEN al >= 1 THEN 60 ELSE 50 END AS severity FROM g WHERE n_events >= 2 AND n_hosts >= 2"""))
def chain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, events = _three(spark, sf_dir)
    return correlate.chains(found, events).withColumn("confidence", F.round("confidence", 6))


_STAGED = """x AS (SELECT *, CASE k % 5 WHEN 0 THEN 'process' WHEN 1 THEN 'network' WHEN 2 THEN 'file' WHEN 3 THEN 'authentication' ELSE 'host' END AS cat,
  CASE k % 7 WHEN 0 THEN 'process_start' WHEN 1 THEN 'user_login' WHEN 2 THEN 'file_modify' WHEN 3 THEN 'file_read' ELSE 'process_start' END AS act,
  CASE k % 6 WHEN 0 THEN 'SUDO ls' WHEN 1 THEN 'chmod x' WHEN 2 THEN 'tar c' ELSE 'ls' END AS cmd, CASE n % 3 WHEN 0 THEN '/etc/passwd' WHEN 1 THEN '/usr/bin/x' END AS path, CASE WHEN n % 2 = 0 THEN '10.0.0.' || (n % 10) ELSE '8.8.8.' || (n % 10) END AS dip,
  CASE n % 4 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 5000 END AS port, n * 100000 AS bytes FROM ecs),
y AS (SELECT *, cat = 'process' AND act = 'process_start' AS started, cmd = 'SUDO ls' AS priv FROM x), z AS (SELECT *, [started AND priv, cat = 'network' AND coalesce(port, 0) <> 443, (started AND priv) OR (cat = 'authentication' AND act = 'user_login')] AS lat,
  [started AND cmd = 'SUDO ls', coalesce(cat = 'file' AND act IN ('file_modify', 'file_read') AND path IS NOT NULL, false), coalesce(cat = 'file' AND act = 'file_modify' AND path = '/etc/passwd', false) OR (started AND cmd IN ('SUDO ls', 'chmod x'))] AS pri,
  [coalesce(cat = 'file' AND act = 'file_read' AND bytes > 1000000, false) OR (started AND cmd = 'tar c'), cat = 'network' AND n % 2 = 1 AND coalesce(port > 1024 OR port = 443, false), cat = 'network' AND bytes > 10000000] AS exf FROM y)"""


@query(duck(_STAGED + """ SELECT event_id, rule, stage FROM (SELECT event_id, unnest(lat) AS hit, unnest([1, 2, 3]) AS stage, 'Lateral Movement' AS rule FROM z UNION ALL SELECT event_id, unnest(pri), unnest([1, 2, 3]), 'Privilege Escalation' FROM z UNION ALL
  SELECT event_id, unnest(exf), unnest([1, 2, 3]), 'Data Exfiltration' FROM z) WHERE hit"""))
def correlation_rule_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages of which rule each event (with made-up fields) meets."""
    e, c = ecs(spark, sf_dir), F.col
    pick = lambda v, m, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c(v) % m + 1).cast("int"))
    rows = e.select(
        "event_id", "host_name", "user_name", F.array(pick("k", 5, "process", "network", "file", "authentication", "host")).alias("category"), pick("k", 7, "process_start", "user_login", "file_modify", "file_read", *["process_start"] * 3).alias("action"),
        pick("k", 6, "SUDO ls", "chmod x", "tar c", "ls", "ls", "ls").alias("command_line"), pick("n", 3, "/etc/passwd", "/usr/bin/x", None).alias("file_path"), F.lit("10.0.0.1").alias("src_ip"), F.lit("outbound").alias("direction"),
        F.concat(F.when(c("n") % 2 == 0, "10.0.0.").otherwise("8.8.8."), (c("n") % 10).cast("string")).alias("dst_ip"), F.when(c("n") % 4 == 0, 443).when(c("n") % 4 == 1, 22).when(c("n") % 4 == 2, 5000).cast("bigint").alias("dst_port"),
        (c("n") * 100000).alias("network_bytes"), (c("n") * 100000).alias("file_size"), F.array(F.lit("connection"), F.lit("flow")).alias("type"), F.lit("x").alias("process_name"),
    )
    parts = [r.stage(rows, i).select("event_id", F.lit(r.name).alias("rule"), F.lit(i + 1).alias("stage")) for r in correlation_rules.RULES for i in range(3)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- analyses


@query(duck(f"""{_GRAPH_SQL} SELECT src_uid, dst_uid, rtype, event_id, ts_us, is_alarm AS is_path_edge, CASE WHEN is_alarm THEN severity ELSE 0 END AS risk, rtype || ' | ' || tactic_id || ' | ' || technique_id AS summary FROM edges
WHERE (src_uid = 'Host:host.id=h-' || substr(sha1('host-3'), 1, 16) OR dst_uid = 'Host:host.id=h-' || substr(sha1('host-3'), 1, 16)) AND ts_us BETWEEN 1704500000000000 AND 1705000000000000"""))
def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    uid = "Host:host.id=h-" + hashlib.sha1(b"host-3").hexdigest()[:16]
    return reports.trace(_edges(spark, sf_dir), uid, 1704500000.0, 1705000000.0)


_USES = "uses AS (SELECT DISTINCT 'G' || s_nationkey AS group_id, 'T1' || lpad((s_suppkey % 37)::VARCHAR, 3, '0') AS technique_id, 'TA00' || lpad((s_suppkey % 11)::VARCHAR, 2, '0') AS tactic_id FROM supplier)"
_IDF = _USES + """, nn AS (SELECT count(DISTINCT group_id) AS big FROM uses), tt AS (SELECT DISTINCT group_id, technique_id AS term FROM uses), aa AS (SELECT DISTINCT group_id, tactic_id AS term FROM uses),
ti AS (SELECT term, count(*) AS df, ln((any_value(big) + 1.0) / (count(*) + 1)) + 1 AS idf FROM tt, nn GROUP BY term), ai AS (SELECT term, count(*) AS df, ln((any_value(big) + 1.0) / (count(*) + 1)) + 1 AS idf FROM aa, nn GROUP BY term)"""


def _uses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    of = lambda lead, m, w: F.concat(F.lit(lead), F.lpad((F.col("s_suppkey") % m).cast("string"), w, "0"))
    group = F.concat(F.lit("G"), F.col("s_nationkey").cast("string")).alias("group_id")
    return s.select(group, of("T1", 37, 3).alias("technique_id")).distinct(), s.select(group, of("TA00", 11, 2).alias("tactic_id")).distinct()


@query(f"WITH {_IDF} SELECT term AS technique_id, df, round(idf, 6) AS idf FROM ti")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses, _ = _uses(spark, sf_dir)
    return ttp.idf(uses, "technique_id", uses.select("group_id").distinct().count()).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_IDF} SELECT group_id, round(sqrt(sum(idf * idf)), 6) AS norm FROM tt JOIN ti USING (term) GROUP BY group_id")
def group_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses, _ = _uses(spark, sf_dir)
    weights = ttp.idf(uses, "technique_id", uses.select("group_id").distinct().count())
    return ttp.norms(uses, weights, "technique_id").withColumn("norm", F.round("norm", 6))


@query(f"""WITH {_IDF}, x AS (SELECT term, idf FROM ti WHERE term IN ('T1001', 'T1005', 'T1017', 'T1023')), y AS (SELECT term, idf FROM ai WHERE term IN ('TA0001', 'TA0007')),
tn AS (SELECT group_id, sqrt(sum(idf * idf)) AS norm FROM tt JOIN ti USING (term) GROUP BY 1), an AS (SELECT group_id, sqrt(sum(idf * idf)) AS norm FROM aa JOIN ai USING (term) GROUP BY 1),
c1 AS (SELECT group_id, sum(idf * idf) / any_value(norm) / (SELECT sqrt(sum(idf * idf)) FROM x) AS c FROM tt JOIN x USING (term) JOIN tn USING (group_id) GROUP BY 1),
c2 AS (SELECT group_id, sum(idf * idf) / any_value(norm) / (SELECT sqrt(sum(idf * idf)) FROM y) AS c FROM aa JOIN y USING (term) JOIN an USING (group_id) GROUP BY 1)
SELECT group_id, round(0.5 * coalesce(c1.c, 0) + 0.5 * coalesce(c2.c, 0), 6) AS score FROM c1 FULL JOIN c2 USING (group_id) ORDER BY round(0.5 * coalesce(c1.c, 0) + 0.5 * coalesce(c2.c, 0), 12) DESC, group_id LIMIT 3""")
def apt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses, tactics = _uses(spark, sf_dir)
    techniques = spark.createDataFrame([(x,) for x in ("T1001", "T1005", "T1017", "T1023", "T1999")], "technique_id string")
    return ttp.ranked(techniques, spark.createDataFrame([("TA0001",), ("TA0007",)], "tactic_id string"), uses, tactics).select("group_id", r6("score"))


def _chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What incidents, chains and paths need of the edges, projected once: each of them reads it several times."""
    return tables.cut(_edges(spark, sf_dir).select("src_uid", "dst_uid", "rtype", "event_id", "ts_float", "is_alarm", "tactic_id", "action"), "edges")


def _chain_alarms(found: DataFrame) -> DataFrame:
    """The alarms of connected incidents over hosts, in order of time."""
    own = found.where("rtype = 'HAS_IP'").select(F.col("dst_uid").alias("ip_uid"), F.col("src_uid").alias("host_uid"))
    return graph.incidents(found.where("rtype <> 'HAS_IP'"), own).withColumn("tactic_name", attack.tactic_name_of_id(F.col("tactic_id")))


_RUNS = """s AS (SELECT host_name AS scope, event_id, tactic_id AS state, ts_us FROM ecs WHERE kind = 'alert'), d AS (SELECT *, coalesce((lag(state) OVER w <> state)::INT, 0) AS ch FROM s WINDOW w AS (PARTITION BY scope ORDER BY ts_us, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY scope ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM d)"""


@query(duck(_RUNS + " SELECT scope, segment, state, min(ts_us) AS t_start, max(ts_us) AS t_end, count(*) AS n_alarms FROM r GROUP BY 1, 2, 3"))
def segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alerts(spark, sf_dir).select(F.col("host_name").alias("scope"), "event_id", F.col("tactic_id").alias("state"), F.col("ts_us").alias("ts_float"), F.col("host_id").alias("src_uid"), F.col("dst_ip").alias("dst_uid"))
    found = fsa.segment_runs(fsa.segments(rows, ["scope"], ["ts_float", "event_id"]), ["scope"])
    return found.select("scope", "segment", "state", "t_start", "t_end", "n_alarms")


@query(duck(_RUNS + ", t AS (SELECT *, row_number() OVER (PARTITION BY scope, segment ORDER BY ts_us, event_id) AS place FROM r) SELECT scope, segment, event_id, place::INT AS place FROM t WHERE place <= 6"))
def top6_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alerts(spark, sf_dir).select(F.col("host_name").alias("scope"), "event_id", F.col("tactic_id").alias("state"), F.col("ts_us").alias("ts_float"))
    found = fsa.top_per_segment(fsa.segments(rows, ["scope"], ["ts_float", "event_id"]), ["scope"])
    return found.select("scope", "segment", "event_id", "place")


@query(duck("x AS (SELECT host_name, ts_us // 3600000000 AS hour, sum(k)::BIGINT AS bytes FROM ecs GROUP BY 1, 2) SELECT host_name, hour, bytes, round(avg(bytes) OVER (PARTITION BY host_name ORDER BY hour ROWS 9 PRECEDING), 6) AS running FROM x"))
def rolling_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = ecs(spark, sf_dir).groupBy("host_name", F.floor(F.col("ts_us") / 3600000000).alias("hour")).agg(F.sum("k").alias("bytes"))
    return reports.running_average(hourly, "host_name", ["hour"], "bytes").withColumn("running", F.round("running", 6))


@query("SELECT o_custkey AS target, max(o_orderkey) AS task_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def latest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    return reports.latest(t, ["target"], ["task_id"]).select("target", "task_id", "status")


@query(duck("x AS (SELECT host_name AS client, ts_us, action AS status, dst_ip FROM ecs), y AS (SELECT client, arg_max(status, ts_us) AS status, arg_max(dst_ip, CASE WHEN dst_ip IS NOT NULL THEN ts_us END) AS dst_ip FROM x GROUP BY 1) SELECT client, status, dst_ip, substr(sha256(client), 1, 12) AS token FROM y"))
def client_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after two partial updates of each client."""
    e = ecs(spark, sf_dir).select(F.col("host_name").alias("client"), "ts_us", F.col("action").alias("status"), "dst_ip")
    half = e.agg(F.median("ts_us").alias("m")).first()["m"]

    def last(df: DataFrame) -> DataFrame:
        seen = F.when(F.col("dst_ip").isNotNull(), F.col("ts_us"))
        return df.groupBy("client").agg(F.max_by("status", "ts_us").alias("status"), F.max_by("dst_ip", seen).alias("dst_ip"))

    out = tables.merged(last(e.where(F.col("ts_us") < half)), last(e.where(F.col("ts_us") >= half)), ["client"])
    return out.select("client", "status", "dst_ip", F.substring(ids.token_hash(F.col("client")), 1, 12).alias("token"))


@query(duck(f"""{_GRAPH_SQL}, a AS (SELECT * FROM edges WHERE is_alarm) SELECT host, array_to_string(list_sort(list(DISTINCT tactic_id)), ',') AS tactics, array_to_string(list_sort(list(DISTINCT technique_id)), ',') AS techniques, count(DISTINCT dst_uid) AS n_targets
FROM (SELECT *, src_uid AS host FROM a WHERE src_uid LIKE 'Host:%') GROUP BY host"""))
def report_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.alarms(_edges(spark, sf_dir)).where("src_uid LIKE 'Host:%'")
    sets = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for c, n in (("tactic_id", "tactics"), ("technique_id", "techniques"))]
    return found.groupBy(F.col("src_uid").alias("host")).agg(*sets, F.count_distinct("dst_uid").alias("n_targets"))


@query()
def fsa_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsa.chains(_chain_alarms(_chain_edges(spark, sf_dir)))


@query()
def killchain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through all edges, alarms or not."""
    found = _chain_edges(spark, sf_dir)
    return killchain.kill_chains(_chain_alarms(found), found)


_FALCO = """f AS (SELECT *, k % 4 AS t, n % 4 AS pr, '/bin/' || process_name AS exe FROM ecs),
g AS (SELECT *, CASE t WHEN 0 THEN 'execve' WHEN 1 THEN 'openat' WHEN 2 THEN 'connect' ELSE 'unlink' END AS evt FROM f),
h AS (SELECT *, 'event' AS kd, CASE WHEN t = 0 THEN 'hostlog.process' ELSE 'hostbehavior.file' END AS ds, CASE WHEN t = 0 THEN 'process' ELSE 'file' END AS cat, CASE t WHEN 0 THEN 'process_start' WHEN 3 THEN 'file_delete' ELSE 'file_read' END AS act FROM g
  UNION ALL SELECT *, 'alert', 'finding.raw.falco', 'intrusion_detection', evt FROM g WHERE pr >= 2)
SELECT event_id AS message, kd AS kind, ds AS dataset, cat AS category, act AS action, ts_us, host_name, host_id, user_name, process_name, exe AS executable, k::BIGINT AS pid,
  'p-' || substr(sha1(host_id || ':' || k || ':' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') || ':' || exe), 1, 16) AS process_entity_id, CASE t WHEN 0 THEN NULL WHEN 2 THEN host_ip || ':1->10.0.0.9:443' ELSE '/etc/passwd' END AS file_path,
  CASE WHEN t = 2 THEN host_ip END AS src_ip, CASE WHEN t = 2 THEN 1 END AS src_port, CASE WHEN t = 2 THEN '10.0.0.9' END AS dst_ip, CASE WHEN t = 2 THEN 443 END AS dst_port, 'Run shell untrusted' AS rule_name,
  CASE pr WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 8 END AS severity, CASE pr WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 40 ELSE 80 END AS risk_score, 'TA0002' AS tactic_id, 'T1059.004' AS technique_id FROM h"""


@query(duck(_FALCO))
def falco_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syscall sensor lines made of the events, mapped to rows of events and alerts."""
    c = F.col
    fields = F.create_map(
        F.lit("proc.name"), c("process_name"), F.lit("proc.pid"), c("k").cast("string"), F.lit("proc.exepath"), F.concat(F.lit("/bin/"), c("process_name")), F.lit("user.name"), c("user_name"),
        F.lit("evt.type"), F.element_at(F.array(*map(F.lit, ["execve", "openat", "connect", "unlink"])), (c("k") % 4 + 1).cast("int")), F.lit("fd.name"), F.when(c("k") % 4 == 2, F.concat("host_ip", F.lit(":1->10.0.0.9:443"))).when(c("k") % 4 != 0, F.lit("/etc/passwd")),
    )
    priority = F.element_at(F.array(*map(F.lit, ["Debug", "Notice", "Warning", "Critical"])), (c("n") % 4 + 1).cast("int"))
    lines = ecs(spark, sf_dir).select(F.to_json(F.struct(
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.lit("Run shell untrusted").alias("rule"), priority.alias("priority"), c("host_name").alias("hostname"), fields.alias("output_fields"), c("event_id").alias("output"),
    )).alias("value"))
    found = sensors.falco(lines)
    same = ["kind", "dataset", "action", "host_name", "host_id", "user_name", "process_name", "executable", "pid", "process_entity_id", "file_path", "src_ip", "src_port", "dst_ip", "dst_port", "rule_name", "severity", "risk_score", "tactic_id", "technique_id"]
    return found.select("message", listed("category"), F.unix_micros("ts").alias("ts_us"), *same)


_KNOWN = ", ".join(f"({i}, '{rule.replace(chr(39), chr(39) * 2)}', '{tactic}', '{technique}')" for i, (rule, (tactic, technique)) in enumerate(sorted(sensors.RULE_ATTACK.items())))


@query(duck(f"""r(i, rule, ta, te) AS (VALUES {_KNOWN}), x AS (SELECT e.*, e.n % 31 AS j FROM ecs e)
SELECT event_id AS message, coalesce(rule, 'Own rule') AS rule_name, coalesce(ta, CASE WHEN j % 2 = 0 THEN 'TA0007' ELSE 'TA0000' END) AS tactic_id,
  coalesce(nullif(te, ''), CASE WHEN rule IS NULL AND j % 2 = 0 THEN 'T1083' ELSE 'T0000' END) AS technique_id FROM x LEFT JOIN r ON r.i = x.j"""))
def falco_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that is known by name, and others, half of which name their tactic and technique in tags."""
    c, j = F.col, F.col("n") % 31
    names = F.array(*map(F.lit, sorted(sensors.RULE_ATTACK)))
    rule = F.coalesce(F.try_element_at(names, (j + 1).cast("int")), F.lit("Own rule"))
    tags = F.when((j >= len(sensors.RULE_ATTACK)) & (j % 2 == 0), F.array(F.lit("mitre.tactic.id=TA0007"), F.lit("attack.technique.id:T1083")))
    lines = ecs(spark, sf_dir).select(F.to_json(F.struct(
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), rule.alias("rule"), F.lit("Debug").alias("priority"), c("host_name").alias("hostname"), tags.alias("tags"), c("event_id").alias("output"),
        F.create_map(F.lit("evt.type"), F.lit("connect")).alias("output_fields"),
    )).alias("value"))
    return sensors.falco(lines).select("message", "rule_name", "tactic_id", "technique_id")


@query(duck("x AS (SELECT 1) SELECT event_id, CASE k % 3 WHEN 0 THEN 'TA0011' WHEN 1 THEN 'TA0002' ELSE 'TA0001' END AS tactic_id, CASE WHEN k % 3 = 2 THEN 'T1078' ELSE 'T0000' END AS technique_id FROM ecs"))
def attack_tactic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tactics given by their number, by their name, or by a technique."""
    tag = F.element_at(F.array(*map(F.lit, ["attack.ta0011", "Attack.Execution", "attack.t1078"])), (F.col("k") % 3 + 1).cast("int"))
    return ecs(spark, sf_dir).select("event_id", normalize.attack_tags(F.array(F.lit("other"), tag)).alias("a")).select("event_id", "a.tactic_id", "a.technique_id")
