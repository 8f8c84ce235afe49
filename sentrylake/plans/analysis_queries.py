"""Queries of reads and jobs over stored tables, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import ids
from sentrylake.operators import analysis, correlate, detect, findings, tables, ttp
from sentrylake.operators.store import KeyedTable, drop_days, scan_days, store_days
from sentrylake.operators.tables import last_of, scratch
from sentrylake.plans.bridge import duck, ecs
from sentrylake.plans.queries import _GRAPH_SQL, _IDF, _THREE, CANONICAL, KEY, RULES, _alerts, _edges, _three, _uses, listed, query, r6

HOST = "host-3"


def _host_id(name: str) -> str:
    import hashlib

    return "h-" + hashlib.sha1(name.encode()).hexdigest()[:16]


@query(duck(f"""c AS (SELECT event_id, technique_id, CASE k % 3 WHEN 0 THEN technique_id || '.00' || (k % 9 + 1) WHEN 1 THEN ' ' || lower(technique_id) ELSE 'T0000' END AS t, CASE k % 5 WHEN 0 THEN 'TA0000' WHEN 1 THEN 'unknown' ELSE tactic_id END AS ta
  FROM ecs WHERE kind = 'alert' AND host_name = '{HOST}' AND ts_us BETWEEN 1704200000000000 AND 1705500000000000),
n AS (SELECT upper(trim(t)) AS t, ta FROM c)
SELECT 'technique' AS what, id FROM (SELECT t AS id FROM n WHERE t NOT LIKE 'T0000%' UNION SELECT split_part(t, '.', 1) FROM n WHERE t NOT LIKE 'T0000%') UNION ALL SELECT 'tactic', ta FROM (SELECT DISTINCT ta FROM n WHERE ta LIKE 'TA%' AND ta <> 'TA0000')"""))
def host_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a host's findings of a window show, in several spellings."""
    k = F.col("k")
    technique = F.when(k % 3 == 0, F.concat("technique_id", F.lit(".00"), (k % 9 + 1).cast("string"))).when(k % 3 == 1, F.concat(F.lit(" "), F.lower("technique_id"))).otherwise("T0000")
    rows = _alerts(spark, sf_dir).withColumns({"technique_id": technique, "tactic_id": F.when(k % 5 == 0, "TA0000").when(k % 5 == 1, "unknown").otherwise(F.col("tactic_id"))})
    techniques, tactics = analysis.host_techniques(rows, _host_id(HOST), 1704200000000000, 1705500000000000)
    return techniques.select(F.lit("technique").alias("what"), F.col("technique_id").alias("id")).unionByName(tactics.select(F.lit("tactic").alias("what"), F.col("tactic_id").alias("id")))


@query(duck("""x AS (SELECT *, CASE k % 4 WHEN 0 THEN 'command_and_control' WHEN 1 THEN 't1059.004' WHEN 2 THEN 't9999' END AS tag FROM ecs WHERE kind = 'alert')
SELECT event_id, ts_us // 1000000 * 1000000 AS ts_us, CASE WHEN k % 5 = 0 THEN 50 ELSE severity END AS severity, round(CASE WHEN k % 6 = 0 THEN 0.7::DOUBLE ELSE confidence END, 6) AS confidence, 'sa-rule-' || CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'd' || k END AS rule_id,
  CASE WHEN k % 2 = 0 THEN 'q' || k WHEN k % 7 = 0 THEN 'Security Analytics Detector' ELSE 'D' || k END AS rule_name, CASE k % 4 WHEN 0 THEN 'TA0011' WHEN 1 THEN 'TA0002' ELSE 'TA0000' END AS tactic_id, CASE k % 4 WHEN 1 THEN 'T1059.004' WHEN 2 THEN 'T9999' END AS technique_id,
  CASE k % 3 WHEN 0 THEN 'unknown' ELSE host_id END AS host_id, CASE k % 3 WHEN 1 THEN 'ev' || k ELSE event_id END AS evidence FROM x"""))
def detector_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's JSON findings, with fields missing here and there."""
    c, k = F.col, F.col("k")
    text = lambda x: F.concat(F.lit(x), k.cast("string"))
    tag = F.concat(F.lit("attack."), F.when(k % 4 == 0, "command_and_control").when(k % 4 == 1, "t1059.004").when(k % 4 == 2, "t9999"))
    first = F.when(k % 3 == 1, F.to_json(F.struct(F.struct(c("host_id").alias("id"), c("host_name").alias("name")).alias("host"), F.struct(text("ev").alias("id")).alias("event")))).when(k % 3 == 2, F.to_json(F.struct(c("host_id").alias("host.id"), c("host_name").alias("host.name"))))
    document = F.coalesce(first, F.lit(""))
    head = F.to_json(F.struct(
        c("event_id").alias("id"), F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(k % 7 != 0, F.struct(text("d").alias("id"), text("D").alias("name"))).alias("detector"),
        F.when(k % 2 == 0, F.array(F.struct(text("q").alias("name"), F.array(tag).alias("tags")))).alias("queries"), F.when(k % 2 == 1, F.array(tag)).alias("tags"), F.when(k % 5 != 0, c("severity")).alias("severity"), F.when(k % 6 != 0, c("confidence")).alias("confidence"),
    ))
    raw = _alerts(spark, sf_dir).select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "document_list": ['), document, F.lit("]}")).alias("value"))
    out = analysis.detector_findings(raw)
    return out.select("event_id", "ts_us", "severity", r6("confidence"), "rule_id", "rule_name", "tactic_id", "technique_id", "host_id", listed("evidence_ids").alias("evidence"))


@query(duck("x AS (SELECT 1) SELECT event_id FROM ecs WHERE kind = 'alert' AND k % 2 = 1"))
def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that aren't stored yet: late ones, repeated ones, and some without a time."""
    rows = _alerts(spark, sf_dir).select("event_id", F.when(F.col("k") % 9 != 4, F.col("ts_us")).alias("ts_us"), "k")
    return analysis.unseen(rows.unionByName(rows.where("k % 3 = 1")), rows.where("k % 2 = 0")).select("event_id")


@query(duck("""x AS (SELECT *, k % 3 AS came FROM ecs WHERE kind = 'alert' AND k % 11 <> 5) SELECT event_id, min(came)::INT AS poll, any_value(ts_us // 1000000 * 1000000) AS ts_us, any_value('sa-rule-d' || k) AS rule_id FROM x GROUP BY event_id"""))
def detector_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls of a detector, each of which gives all that came before once more, in a stored table; some lines are unusable."""
    rows, k = _alerts(spark, sf_dir), F.col("k")
    usable = k % 11 != 5
    line = F.to_json(F.struct(F.when(usable, F.col("event_id")).alias("id"), F.when(usable, F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), F.struct(F.concat(F.lit("d"), k.cast("string")).alias("id")).alias("detector")))
    table = KeyedTable(spark, scratch(spark, "detector-flow"), ["event_id"], analysis.detector_findings(rows.limit(0).select(line.alias("value"))).schema, buckets=8)
    first = {}
    for n in range(3):
        analysis.poll(rows.where(k % 3 <= n).select(line.alias("value")), table, F.timestamp_micros(F.lit(0)))
        first[n] = table.manifest()
    out, polls = None, [table.read(manifest=first[n]).select("event_id", "ts_us", "rule_id") for n in range(3)]
    for n, now in enumerate(polls):
        mine = (now if n == 0 else now.join(polls[n - 1].select("event_id"), "event_id", "left_anti")).withColumn("poll", F.lit(n))
        out = mine if out is None else out.unionByName(mine)
    return out


@query(duck("x AS (SELECT host_name || '/' || (n % 50) AS key, n, action, dst_ip, k % 3 AS batch FROM ecs) SELECT key, arg_max(n, (batch, n)) AS n, arg_max(action, (batch, n)) AS action, max(struct_pack(b := batch, n := n, d := dst_ip)).d AS dst_ip FROM x GROUP BY key"))
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits of rows by key with a compaction between; of a key the last commit counts, and in it the last row."""
    rows = ecs(spark, sf_dir).select(F.concat("host_name", F.lit("/"), (F.col("n") % 50).cast("string")).alias("key"), "n", "action", "dst_ip", "k")
    table = KeyedTable(spark, scratch(spark, "compacted"), ["key"], "key string, n long, action string, dst_ip string", buckets=8, order=("n",))
    for batch in range(3):
        table.append(rows.where(F.col("k") % 3 == batch), batch)
        if batch == 1:
            table.compact()
    return table.read()


@query(duck("x AS (SELECT 1) SELECT event_id, ts_us, action FROM ecs WHERE event_id IN ('evt-0', 'evt-7', 'evt-77', 'evt-777', 'evt-none')"))
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some events of a stored table, by id: their buckets alone are read."""
    rows = ecs(spark, sf_dir).select("event_id", "ts_us", "action", "kind")
    table = KeyedTable(spark, scratch(spark, "by-id"), ["event_id"], "event_id string, ts_us long, action string", buckets=16)
    for kind in ("event", "alert"):
        table.append(rows.where(F.col("kind") == kind))
    return table.lookup(["evt-0", "evt-7", "evt-77", "evt-777", "evt-none"])


@query(duck("x AS (SELECT *, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day FROM ecs) SELECT event_id, ts_us, day FROM x WHERE day BETWEEN '2024-01-05' AND '2024-01-08' AND dataset LIKE 'netflow.%'"))
def multi_day_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by day, of four days."""
    path = scratch(spark, "days")
    store_days(ecs(spark, sf_dir).select("event_id", "ts_us", "dataset"), path)
    return scan_days(spark, path, "2024-01-05", "2024-01-08").where("dataset LIKE 'netflow.%'").select("event_id", "ts_us", "day")


@query(duck("x AS (SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day FROM ecs), m AS (SELECT max(day) AS last FROM x) SELECT day, count(*) AS n FROM x, m WHERE day >= strftime(last::DATE - 10, '%Y-%m-%d') GROUP BY day"))
def retained_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention leaves of events stored by day, ten days before the last."""
    path = scratch(spark, "retained")
    store_days(ecs(spark, sf_dir).select("event_id", "ts_us"), path)
    days = spark.read.parquet(path).agg(F.max(F.col("day").cast("string")).alias("d")).first()["d"]
    drop_days(spark, path, 10, days)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{duck("hx AS (SELECT 1)")}, {_IDF}, al AS (SELECT host_id || '@' || (ts_us // 86400000000) AS entity, k FROM ecs WHERE kind = 'alert'),
ht AS (SELECT DISTINCT entity, 'T1' || lpad((k % 41)::VARCHAR, 3, '0') AS term FROM al), ha AS (SELECT DISTINCT entity, 'TA00' || lpad((k % 11)::VARCHAR, 2, '0') AS term FROM al WHERE k % 11 > 0),
gt AS (SELECT group_id, sqrt(sum(idf * idf)) AS norm FROM tt JOIN ti USING (term) GROUP BY 1), ga AS (SELECT group_id, sqrt(sum(idf * idf)) AS norm FROM aa JOIN ai USING (term) GROUP BY 1),
nt AS (SELECT entity, sqrt(sum(idf * idf)) AS own FROM ht JOIN ti USING (term) GROUP BY 1), na AS (SELECT entity, sqrt(sum(idf * idf)) AS own FROM ha JOIN ai USING (term) GROUP BY 1),
c1 AS (SELECT entity, group_id, sum(idf * idf) / any_value(norm) / any_value(own) AS c FROM ht JOIN ti USING (term) JOIN tt USING (term) JOIN gt USING (group_id) JOIN nt USING (entity) GROUP BY 1, 2),
c2 AS (SELECT entity, group_id, sum(idf * idf) / any_value(norm) / any_value(own) AS c FROM ha JOIN ai USING (term) JOIN aa USING (term) JOIN ga USING (group_id) JOIN na USING (entity) GROUP BY 1, 2),
sc AS (SELECT entity, group_id, 0.5 * coalesce(c1.c, 0) + 0.5 * coalesce(c2.c, 0) AS score FROM c1 FULL JOIN c2 USING (entity, group_id)),
pl AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(score, 12) DESC, group_id)::INT AS place FROM sc) SELECT entity, place, group_id, round(score, 6) AS score FROM pl WHERE place <= 3""")
def host_apt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three groups that each host's day is most like, by its findings' techniques and tactics (made-up here)."""
    uses, tactics = _uses(spark, sf_dir)
    k = F.col("k")
    made = lambda lead, m, w: F.concat(F.lit(lead), F.lpad((k % m).cast("string"), w, "0"))
    rows = _alerts(spark, sf_dir).withColumns({"technique_id": made("T1", 41, 3), "tactic_id": made("TA00", 11, 2)})
    return ttp.ranked_all(*analysis.techniques_by_host(rows, 86_400_000_000), uses, tactics).select("entity", "place", "group_id", r6("score"))


@query(duck(f"""{_GRAPH_SQL}, t AS (SELECT *, CASE WHEN severity % 2 = 0 THEN 'trace-1' ELSE 'trace-2' END AS task, severity % 3 = 0 AS on_path FROM edges WHERE is_alarm)
SELECT src_uid, dst_uid, rtype, event_id, 'all' AS which FROM t WHERE task = 'trace-1' UNION ALL SELECT src_uid, dst_uid, rtype, event_id, 'path' FROM t WHERE task = 'trace-1' AND on_path"""))
def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _edges(spark, sf_dir).where("is_alarm").withColumns({"task_id": F.when(F.col("severity") % 2 == 0, "trace-1").otherwise("trace-2"), "is_path_edge": F.col("severity") % 3 == 0})
    keys = ["src_uid", "dst_uid", "rtype", "event_id"]
    parts = [analysis.task_edges(found, "trace-1", path).select(*keys, F.lit(name).alias("which")) for name, path in (("all", False), ("path", True))]
    return parts[0].unionByName(parts[1])


@query(duck("x AS (SELECT *, ts_us + (k % 5) * 3600000000 AS came FROM ecs) SELECT event_id, came AS ingested_us FROM x WHERE kind = 'event' AND dataset = 'netflow.flow' AND came BETWEEN 1704300000000000 AND 1705200000000000 ORDER BY came, event_id LIMIT 5000"))
def ingested_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window by time of arrival (hours after the event here), in its order."""
    rows = ecs(spark, sf_dir).withColumn("ingested_us", F.col("ts_us") + (F.col("k") % 5).cast("long") * 3_600_000_000)
    return analysis.ingested_window(rows, "event", 1704300000000000, 1705200000000000, "netflow.flow").select("event_id", "ingested_us")


@query(duck(CANONICAL.format(key=KEY.format(m=1440))) + "SELECT event_id, fingerprint, ts_us, technique_id FROM c WHERE technique_id = 'T1041' AND ts_us BETWEEN 1704200000000000 AND 1705500000000000")
def canonical_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.canonical(_alerts(spark, sf_dir), 1440)
    return analysis.canonical_lookup(found, 1704200000000000, 1705500000000000, technique_id="T1041").select("event_id", "fingerprint", "ts_us", "technique_id")


@query(duck("x AS (SELECT 1) SELECT event_id, host_name, severity, 'event' AS side FROM ecs WHERE kind = 'event' AND action = 'click' UNION ALL SELECT event_id, NULL, severity, 'finding' FROM ecs WHERE kind = 'alert'"))
def events_and_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and findings in one read; the condition is for events alone."""
    rows = ecs(spark, sf_dir)
    return analysis.combined(rows.where("kind = 'event'").select("event_id", "host_name", "severity", "action"), rows.where("kind = 'alert'").select("event_id", "severity"), F.col("action") == "click").drop("action")


_TAGGED = """m AS (SELECT *, action || ' by ' || user_name || ' on ' || host_name AS s FROM ecs WHERE kind = 'event'),
h AS (SELECT *, list_filter([CASE WHEN contains(s, 'click') THEN 'click' END, CASE WHEN contains(s, 'user-1') THEN 'user' END], lambda x: x IS NOT NULL) AS l FROM m),
r AS (SELECT event_id, CASE WHEN len(l) > 0 THEN 'alert' ELSE kind END AS kind, CASE WHEN len(l) > 0 THEN 'finding.raw.filebeat_sigma' ELSE dataset END AS dataset, CASE l[1] WHEN 'click' THEN 70 WHEN 'user' THEN 30 END AS severity, CASE WHEN len(l) > 0 THEN len(l)::INT END AS rule_count,
  'rule-' || substr(sha1(l[1]), 1, 16) AS rule_id, CASE WHEN len(l) > 0 THEN 'intrusion_detection' END AS category, CASE l[1] WHEN 'click' THEN 'T1059' END AS technique_id, CASE l[1] WHEN 'click' THEN 'TA0002' END AS tactic_id FROM h)"""


def _rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [detect.MessageRule("click", "high", contains=("click",), tags=("attack.t1059",)), detect.MessageRule("user", "low", contains=("USER-1",))]
    message = F.concat_ws(" ", F.col("action"), F.lit("by"), F.col("user_name"), F.lit("on"), F.col("host_name"))
    rows = ecs(spark, sf_dir).where("kind = 'event'").select("event_id", "kind", "dataset", F.lit(None).cast("int").alias("severity"), F.lit(None).cast("array<string>").alias("category"), message.alias("message"))
    out = analysis.rule_alerts(detect.matched(rows, rules))
    return out.select("event_id", "kind", "dataset", "severity", "rule_count", "rule_id", F.array_join("category", ",").alias("category"), "technique_id", "tactic_id")


@query(duck(_TAGGED + " SELECT * FROM r"))
def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in which message rules match become alerts."""
    return _rule_alerts(spark, sf_dir)


@query(duck(_TAGGED + " SELECT event_id, kind, dataset FROM r WHERE kind = 'alert' OR dataset = 'hostlog.auth'"))
def publish_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.publishable(_rule_alerts(spark, sf_dir)).select("event_id", "kind", "dataset")


@query(duck(_THREE + """, m AS (SELECT DISTINCT correlation_id, unnest([id1, id2, id3]) AS event_id FROM c3), j AS (SELECT m.correlation_id, l.event_id, l.ts_us, l.host_name FROM m JOIN l USING (event_id))
SELECT correlation_id, (row_number() OVER w)::INT AS place, event_id, ts_us, host_name, ts_us - min(ts_us) OVER (PARTITION BY correlation_id) AS since_us FROM j WINDOW w AS (PARTITION BY correlation_id ORDER BY ts_us, event_id)"""))
def chain_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.timeline(*_three(spark, sf_dir))


_CHAIN_FINDINGS = """, m AS (SELECT DISTINCT correlation_id, unnest([id1, id2, id3]) AS event_id FROM c3), j AS (SELECT m.correlation_id, l.* FROM m JOIN l USING (event_id)),
g AS (SELECT correlation_id, count(*) AS n_events, count(DISTINCT host_id) AS n_hosts, avg(level) AS al, min(ts_us) AS first_us, arg_min(host_id, (ts_us, event_id)) AS host_id, array_to_string(list_sort(list(event_id)), ',') AS evidence FROM j GROUP BY 1),
cf AS (SELECT 'lateral-movement-' || substr(md5(correlation_id), 1, 16) AS event_id, first_us AS ts_us, host_id, CASE WHEN al >= 3 THEN 80 WHEN al >= 2 THEN 70 WHEN al >= 1 THEN 60 ELSE 50 END AS severity, evidence FROM g WHERE n_events >= 2 AND n_hosts >= 2)"""


@query(duck(_THREE + _CHAIN_FINDINGS + " SELECT event_id, ts_us, host_id, severity, evidence, 'T1021' AS technique_id, 'correlation_rules' AS provider, 'Lateral Movement' AS rule_name FROM cf"))
def chain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, events = _three(spark, sf_dir)
    out = correlate.chain_findings(correlate.chains(found, events), found, events)
    return out.select("event_id", "ts_us", "host_id", "severity", listed("evidence_ids").alias("evidence"), "technique_id", "provider", "rule_name")


@query(duck(_THREE + _CHAIN_FINDINGS + f""", f AS (SELECT concat_ws('|', technique_id, host_id, coalesce(process_entity_id, CASE WHEN dst_ip IS NOT NULL THEN concat_ws('|', dst_ip, dst_domain) END, file_sha256, 'unknown'), cast(ts_us // 1000 // 86400000 AS VARCHAR)) AS key, provider, severity FROM ecs WHERE kind = 'alert'
UNION ALL SELECT 'T1021|' || host_id || '|unknown|' || (ts_us // 1000 // 86400000), 'correlation_rules', severity FROM cf)
SELECT 'fp-' || sha1(key) AS fingerprint, count(*) AS n_merged, max(severity) AS severity, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM f GROUP BY key"""))
def correlated_and_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation before the merge, in one run: what it finds is merged with the raw findings of a day."""
    found, events = _three(spark, sf_dir)
    made = correlate.chain_findings(correlate.chains(found, events), found, events)
    raw = _alerts(spark, sf_dir)
    rows = raw.unionByName(made.select([c for c in made.columns if c in raw.columns]), allowMissingColumns=True)
    return findings.canonical(rows, 1440).select("fingerprint", "n_merged", "severity", listed("providers"))


@query(duck("""x AS (SELECT host_name AS client, n, action, dst_ip FROM ecs), u AS (SELECT client || '/' || (n % 50) AS key, n, action, dst_ip FROM x)
SELECT key, arg_max(n, n) AS n, arg_max(action, n) AS action, max(struct_pack(n := n, d := dst_ip)).d AS dst_ip FROM u GROUP BY key"""))
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows by key in two writes, each of which repeats keys."""
    rows = ecs(spark, sf_dir).select(F.concat("host_name", F.lit("/"), (F.col("n") % 50).cast("string")).alias("key"), "n", "action", "dst_ip")
    half = rows.agg(F.median("n").alias("m")).first()["m"]
    stored = last_of(rows.where(F.col("n") < half), ["key"], ["n"])
    return tables.upserted(stored, rows.where(F.col("n") >= half), ["key"], ["n"]).select("key", "n", "action", "dst_ip")


@query(duck(CANONICAL.format(key=KEY.format(m=1440))) + "SELECT fingerprint, event_id, n_merged, severity, providers FROM c")
def canonical_across_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that come in two batches, the second merged with what is stored of the fingerprints that it touches."""
    raw = _alerts(spark, sf_dir).withColumn("fingerprint", ids.fingerprint_id(findings.fingerprint_key(1440)))
    first, second = raw.where("k % 3 = 0"), raw.where("k % 3 <> 0")
    columns = ["fingerprint", "event_id", "n_merged", "severity", "providers"]
    stored = findings.canonical(first, 1440).select(columns)
    touched = second.select("fingerprint").distinct()
    again = findings.canonical(second.unionByName(first.join(touched, "fingerprint", "left_semi").select(second.columns)), 1440).select(columns)
    return tables.upserted(stored, again, ["fingerprint"]).select("fingerprint", "event_id", "n_merged", "severity", listed("providers"))

