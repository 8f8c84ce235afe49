"""The events table as ECS telemetry, in SQL that Spark and DuckDB share but for a few function names.

An event's host is its user modulo 10, its process its type, its user its user_id, its destination address and tactic
follow from props and type, and events over ALERT_OVER are alerts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALERT_OVER = 40.0

#: Times in the table have no zone and are UTC, whatever the session's zone is.
UTC_TS = "cast(convert_timezone('UTC', current_timezone(), cast(ts AS TIMESTAMP_NTZ)) AS TIMESTAMP)"
SPARK = {"us": f"unix_micros({UTC_TS})", "k": "cast(get_json_object(props, '$.k') AS INT)", "long": "BIGINT", "string": "STRING", "idiv": "div", "double": "DOUBLE"}
DUCK = {"us": "epoch_us(ts)", "k": "cast(json_extract_string(props, '$.k') AS INT)", "long": "BIGINT", "string": "VARCHAR", "idiv": "//", "double": "DOUBLE"}

_TEMPLATE = """
SELECT event_id AS n, 'evt-' || cast(event_id AS {string}) AS event_id, {us} AS ts_us,
  CASE WHEN value > {over} THEN 'alert' ELSE 'event' END AS kind,
  CASE WHEN value > {over} THEN 'finding.raw.falco' WHEN event_type = 'view' THEN 'netflow.flow' WHEN event_type = 'signup' THEN 'hostlog.auth'
    WHEN event_type = 'click' THEN 'hostlog.process' WHEN event_type = 'error' THEN 'hostbehavior.file' ELSE 'netflow.dns' END AS dataset,
  event_type AS action, user_id,
  'host-' || cast(user_id % 10 AS {string}) AS host_name, 'h-' || substr(sha1('host-' || cast(user_id % 10 AS {string})), 1, 16) AS host_id,
  'user-' || cast(user_id AS {string}) AS user_name, 'proc-' || event_type AS process_name,
  CASE WHEN {k} % 4 = 0 THEN 'p-' || substr(sha1('host-' || cast(user_id % 10 AS {string}) || event_type), 1, 16) END AS process_entity_id,
  CASE WHEN {k} % 4 IN (1, 2) THEN '10.0.0.' || cast({k} AS {string}) END AS dst_ip,
  CASE WHEN {k} % 4 = 2 THEN 'd' || cast({k} % 7 AS {string}) || '.example' END AS dst_domain,
  CASE WHEN {k} % 8 = 3 THEN substr(sha1('file' || cast({k} AS {string})), 1, 40) END AS file_sha256,
  '10.0.0.' || cast(user_id % 10 AS {string}) AS host_ip,
  cast(least(100, floor(value)) AS INT) AS severity, least(1.0, value / 200.0) AS confidence, value, {k} AS k,
  CASE event_type WHEN 'signup' THEN 'TA0001' WHEN 'view' THEN 'TA0007' WHEN 'click' THEN 'TA0002' WHEN 'error' THEN 'TA0004' ELSE 'TA0010' END AS tactic_id,
  CASE event_type WHEN 'signup' THEN 'T1078' WHEN 'view' THEN 'T1083' WHEN 'click' THEN 'T1059' WHEN 'error' THEN 'T1548' ELSE 'T1041' END AS technique_id,
  CASE {k} % 3 WHEN 0 THEN 'falco' WHEN 1 THEN 'suricata' ELSE 'filebeat_sigma' END AS provider
FROM {table}
"""


def sql(dialect: dict[str, str], table: str = "events") -> str:
    return _TEMPLATE.format(**dialect, over=ALERT_OVER, table=table)


def ecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridged events."""
    return spark.sql(_TEMPLATE.format(**SPARK, over=ALERT_OVER, table="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def duck(rest: str) -> str:
    """A DuckDB query over the bridged events, named ecs."""
    return f"WITH ecs AS ({sql(DUCK)}), {rest}"
